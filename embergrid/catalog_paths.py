"""Queries for placement by auction, searches for many pairs, bridges and as-of look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _NATIONS, LINKS_SQL, PART0, _ids, _nation_graph, network_links, query, table
from .operators import assignment as B
from .operators import paths as S
from .operators.asof import as_of_join
from .operators.bridges import bridges as find_bridges
from .operators.storage import saved

_TRADE = "t AS (SELECT o_custkey AS person, l_suppkey AS object, sum(l_quantity)::BIGINT AS benefit FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), c AS (SELECT s_suppkey AS object, (floor(s_acctbal)::BIGINT + 2000) // 1000 + 1 AS slots FROM supplier)"


def _trade(spark, d):
    """What each customer bought from each supplier, and the suppliers' slots by their balance: fewer than customers."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    lines = li.select("l_orderkey", "l_suppkey", "l_quantity").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = lines.groupBy(F.col("o_custkey").alias("person"), F.col("l_suppkey").alias("object")).agg(F.sum("l_quantity").cast("long").alias("benefit"))
    s = table(spark, d, "supplier")
    return pairs, s.select(F.col("s_suppkey").alias("object"), (F.floor((F.floor("s_acctbal") + 2000) / 1000) + 1).alias("slots"))


EPSILON = 8.0


@query("auction_placement", f"WITH {_TRADE} SELECT person, count(*) AS pairs, max(benefit) AS most, true AS valid, true AS content, (SELECT sum(slots)::BIGINT FROM c) AS slots, true AS bounded FROM t GROUP BY person")
def auction_placement(spark, d):
    """All customers on suppliers, with the certificate: each customer's place is one of its pairs, no other is worth more at its
    price by over EPSILON; no supplier is over its slots, and the dual bound exceeds the benefit by EPSILON a customer at most."""
    pairs, slots = (saved(x) for x in _trade(spark, d))
    found = B.auction(pairs, slots, EPSILON)
    own = found.placed.join(pairs.withColumnRenamed("benefit", "b"), ["person", "object"], "left").groupBy("person").agg((F.count("*") == 1).alias("once"), F.bool_and(F.coalesce(F.col("b") == F.col("benefit"), F.lit(False))).alias("real"))
    sad = B.unhappy(pairs, found.prices, found.placed, EPSILON).select("person", F.lit(True).alias("sad"))
    out = pairs.groupBy("person").agg(F.count("*").alias("pairs"), F.max("benefit").alias("most"))
    over = found.placed.groupBy("object").count().join(slots, "object", "left").where("slots is null or count > slots")
    near = -1e-6 <= found.dual - found.primal <= EPSILON * out.count() + 1e-6 and over.isEmpty()
    room = slots.agg(F.sum("slots")).first()[0]
    out = out.join(own, "person", "left").join(sad, "person", "left")
    valid = F.coalesce("once", F.lit(True)) & F.coalesce("real", F.lit(True))
    return out.select("person", "pairs", "most", valid.alias("valid"), F.col("sad").isNull().alias("content"), F.lit(room).cast("long").alias("slots"), F.lit(near).alias("bounded"))


@query("k_shortest_nations", f"WITH RECURSIVE {_NATIONS}, p(source, target, h, cost, path) AS (SELECT id, id, 0, 0::BIGINT, [id] FROM n UNION ALL SELECT p.source, a.dst, h + 1, cost + w, list_append(path, a.dst) FROM p JOIN a ON a.src = p.target WHERE h < 3 AND NOT list_contains(path, a.dst)) SELECT source, target, rank::INT AS rank, cost::DOUBLE AS cost, array_to_string(path, '-') AS path FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY cost, h, path) AS rank FROM p WHERE source < target) WHERE rank <= 3")
def k_shortest_nations(spark, d):
    """The three cheapest loopless paths of at most three hops between all nations."""
    links = saved(_nation_graph(spark, d))
    ids = _ids(links)
    pairs = ids.withColumnRenamed("id", "source").join(ids.withColumnRenamed("id", "target"), F.col("source") < F.col("target"))
    return S.k_shortest_paths(links, pairs, 3, "w", max_hops=3).withColumn("path", F.concat_ws("-", F.col("path").cast("array<string>")))


_NEXT = "pairs AS (SELECT s_suppkey AS source, lead(s_suppkey) OVER (ORDER BY s_suppkey) AS target FROM supplier)"


def _next_supplier(spark, d):
    """Each supplier and the one with the next key."""
    from .operators.attributes import with_position

    at = with_position(table(spark, d, "supplier").select(F.col("s_suppkey").alias("source")), [F.col("source")], "at")
    return at.join(at.select(F.col("source").alias("target"), (F.col("at") - 1).alias("at")), "at").select("source", "target")


@query("two_sided_lengths", f"WITH RECURSIVE {LINKS_SQL}, {_NEXT}, m(s, id, d) USING KEY (s, id) AS (SELECT source, source, 0::BIGINT FROM pairs WHERE target IS NOT NULL UNION SELECT m.s, a.dst, min(m.d + a.w) FROM m JOIN a ON a.src = m.id LEFT JOIN recurring.m r ON r.s = m.s AND r.id = a.dst WHERE r.id IS NULL OR m.d + a.w < r.d GROUP BY m.s, a.dst) SELECT source, target, d::DOUBLE AS distance FROM pairs JOIN m ON s = source AND id = target")
def two_sided_lengths(spark, d):
    """The distance of each supplier to the next one over all line items, by search from both ends."""
    return S.two_sided_paths(network_links(spark, d), _next_supplier(spark, d), "w").select("source", "target", "distance")


_TIES = _NATIONS.replace("count(*) AS w", "1 + count(*) % 3 AS w")
_DISTANCES = f"WITH RECURSIVE {_TIES}, m(s, id, d) USING KEY (s, id) AS (SELECT id, id, 0::BIGINT FROM n UNION SELECT m.s, a.dst, min(m.d + a.w) FROM m JOIN a ON a.src = m.id LEFT JOIN recurring.m r ON r.s = m.s AND r.id = a.dst WHERE r.id IS NULL OR m.d + a.w < r.d GROUP BY m.s, a.dst), t(s, id, path) AS (SELECT id, id, id::VARCHAR FROM n UNION ALL SELECT t.s, a.dst, t.path || '-' || a.dst FROM t JOIN a ON a.src = t.id JOIN m x ON x.s = t.s AND x.id = t.id JOIN m y ON y.s = t.s AND y.id = a.dst AND y.d = x.d + a.w)"


def _tied(spark, d):
    links = saved(_nation_graph(spark, d).withColumn("w", 1 + F.col("w") % 3))
    ids = _ids(links)
    return links, ids.withColumnRenamed("id", "source").join(ids.withColumnRenamed("id", "target"), F.col("source") < F.col("target"))


@query("tied_paths", f"{_DISTANCES} SELECT t.s AS source, t.id AS target, m.d::DOUBLE AS distance, path FROM t JOIN m ON m.s = t.s AND m.id = t.id WHERE t.s < t.id")
def tied_paths(spark, d):
    """All shortest paths between the nations, by weights with many ties."""
    return S.tied_paths(*_tied(spark, d), "w").withColumn("path", F.concat_ws("-", F.col("path").cast("array<string>")))


@query("tied_path_counts", f"{_DISTANCES} SELECT t.s AS source, t.id AS target, min(m.d)::DOUBLE AS distance, count(*) AS paths FROM t JOIN m ON m.s = t.s AND m.id = t.id WHERE t.s < t.id GROUP BY ALL")
def tied_path_counts(spark, d):
    return S.tight_arcs(*_tied(spark, d), "w")[1]


_ORDERS = f"e AS (SELECT DISTINCT l_suppkey AS src, l_orderkey + {2 * PART0} AS dst FROM lineitem), a AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), n AS (SELECT DISTINCT src AS id FROM a)"


@query("bridges", f"WITH RECURSIVE {_ORDERS}, b(id, root) USING KEY (id) AS (SELECT id, id FROM n UNION SELECT a.dst, min(b.root) FROM b JOIN a ON a.src = b.id JOIN recurring.b r ON r.id = a.dst WHERE b.root < r.root GROUP BY a.dst), s(id, d) USING KEY (id) AS (SELECT DISTINCT root, 0 FROM b UNION SELECT a.dst, min(s.d + 1) FROM s JOIN a ON a.src = s.id LEFT JOIN recurring.s r ON r.id = a.dst WHERE r.id IS NULL GROUP BY a.dst), u AS (SELECT a.dst AS id, min(a.src) AS up FROM a JOIN s x ON x.id = a.src JOIN s y ON y.id = a.dst AND y.d = x.d + 1 GROUP BY a.dst), c(x, y) AS (SELECT src, dst FROM e ANTI JOIN u h ON h.id = e.src AND h.up = e.dst ANTI JOIN u i ON i.id = e.dst AND i.up = e.src UNION SELECT CASE WHEN p.d >= q.d THEN f.up ELSE x END, CASE WHEN p.d >= q.d THEN y ELSE g.up END FROM c JOIN s p ON p.id = x JOIN s q ON q.id = y LEFT JOIN u f ON f.id = x LEFT JOIN u g ON g.id = y WHERE x <> y), k AS (SELECT DISTINCT CASE WHEN p.d >= q.d THEN x ELSE y END AS id FROM c JOIN s p ON p.id = x JOIN s q ON q.id = y WHERE x <> y) SELECT least(id, up) AS src, greatest(id, up) AS dst FROM u WHERE id NOT IN (SELECT id FROM k)")
def bridges(spark, d):
    """Links between suppliers and orders, over all line items, without which the network falls apart."""
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_orderkey") + 2 * PART0).alias("dst"))
    return find_bridges(links)


@query("as_of_purchase", "WITH r AS (SELECT user_id, ts, max(event_id) AS purchase, arg_max(value, event_id) AS paid FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT l.event_id, l.user_id, coalesce(r.purchase, -1) AS purchase, coalesce(r.paid, -1) AS paid FROM events l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts WHERE l.event_type <> 'purchase'")
def as_of_purchase(spark, d):
    """Each other event with its user's latest purchase up to then, or -1."""
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"), F.col("value").alias("paid"))
    return as_of_join(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "purchase", ["purchase", "paid"]).drop("ts").na.fill(-1)
