"""All queries of the library by name, and the SQL that DuckDB holds them against.

The tables stand for networks: suppliers are physical nodes, customers virtual nodes, line items
links between suppliers and parts (weight: the least line number), orders requests. All queries take
whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import resources as R
from .operators import aggregates as A
from .operators import attributes as P
from .operators import graph as G
from .operators import ranking as K
from .operators.storage import dealt, saved
from .plans import accounting as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PART0 = 1_000_000_000


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def physical(spark, d) -> DataFrame:
    """Suppliers as nodes: cpu and ram from the account balance."""
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (F.floor("s_acctbal") + 2000).alias("cpu"), (F.col("s_nationkey").cast("long") * 100).alias("ram"), F.col("s_nationkey").alias("nation"))


def network_links(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART0).alias("dst"), "l_linenumber")
    return saved(dealt(li, "src", "dst").groupBy("src", "dst").agg(F.min("l_linenumber").cast("long").alias("w"), F.count("*").alias("bw")))


def network_nodes(spark, d) -> DataFrame:
    """The ends of all links, read from the lines: they are few beside the links."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("id")).union(li.select(F.col("l_partkey") + PART0)).distinct()


PHYSICAL_SQL = "p AS (SELECT s_suppkey AS id, floor(s_acctbal)::BIGINT + 2000 AS cpu, s_nationkey::BIGINT * 100 AS ram, s_nationkey AS nation FROM supplier)"
LINKS_SQL = f"e AS (SELECT l_suppkey AS src, l_partkey + {PART0} AS dst, min(l_linenumber)::BIGINT AS w, count(*) AS bw FROM lineitem GROUP BY ALL), a AS (SELECT src, dst, w, bw FROM e UNION ALL SELECT dst, src, w, bw FROM e), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"


@query(
    "flagship_candidate_ffd",
    f"""WITH {PHYSICAL_SQL}, v AS (SELECT c_custkey, c_nationkey, greatest(floor(c_acctbal), 0)::BIGINT AS demand FROM customer),
    b AS (SELECT c_custkey, c_nationkey, demand, id, row_number() OVER (PARTITION BY c_custkey ORDER BY cpu + ram DESC, id) AS r FROM v JOIN p ON nation = c_nationkey AND demand <= cpu)
    SELECT c_nationkey, count(*) AS placed, sum(demand)::BIGINT AS revenue, count(DISTINCT id) AS used FROM b WHERE r = 1 GROUP BY c_nationkey""",
)
def flagship_candidate_ffd(spark, d):
    """Each customer on the feasible supplier of its nation with most resources; totals by nation."""
    v = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.greatest(F.floor("c_acctbal"), F.lit(0)).alias("demand"))
    offers = physical(spark, d).withColumn("score", F.col("cpu") + F.col("ram")).withColumnRenamed("nation", "c_nationkey")
    best = K.best_offer(v, offers, ["c_nationkey"], "demand", "cpu", F.struct("score", -F.col("id")), ["id"])
    return best.groupBy("c_nationkey").agg(F.count("*").alias("placed"), F.sum("demand").alias("revenue"), F.countDistinct("id").alias("used"))


@query(
    "satisfiability_offsets",
    f"""WITH {PHYSICAL_SQL} SELECT id, cpu >= 5000 AS le_ok, 5000 - cpu AS le_offset, cpu <= 5000 AS ge_ok, cpu - 5000 AS ge_offset, cpu = 5000 AS eq_ok, abs(5000 - cpu) AS eq_offset, true AS soft_ok FROM p""",
)
def satisfiability_offsets(spark, d):
    v, c = F.lit(5000).cast("long"), F.col("cpu")
    flags = {f"{h}_ok": R.satisfied(v, c, h) for h in ("le", "ge", "eq")} | {f"{h}_offset": R.offset(v, c, h) for h in ("le", "ge", "eq")}
    return physical(spark, d).select("id", *[x.alias(k) for k, x in flags.items()], R.satisfied(v, c, soft=True).alias("soft_ok"))


@query("multi_resource_check", f"WITH {PHYSICAL_SQL} SELECT id, (4000 <= cpu AND 900 <= ram) AS ok, 4000 - cpu AS cpu_offset, 900 - ram AS ram_offset FROM p")
def multi_resource_check(spark, d):
    ok, offsets = R.check({"cpu": (F.lit(4000).cast("long"), F.col("cpu")), "ram": (F.lit(900).cast("long"), F.col("ram"))})
    return physical(spark, d).select("id", ok.alias("ok"), offsets.alias("o")).select("id", "ok", F.col("o.cpu").alias("cpu_offset"), F.col("o.ram").alias("ram_offset"))


@query("available_links", f"WITH {LINKS_SQL} SELECT src, dst, bw FROM e WHERE bw >= 2 * 0.75 - 0.5")
def available_links(spark, d):
    return P.available(network_links(spark, d), {"bw": 2}, 0.75, 0.5).select("src", "dst", "bw")


@query("resource_sum_by_nation", f"WITH {PHYSICAL_SQL} SELECT nation, sum(cpu + ram)::DOUBLE AS total FROM p GROUP BY nation")
def resource_sum_by_nation(spark, d):
    return A.resource_sum(physical(spark, d), ["cpu", "ram"], ["nation"])


@query("degree", f"WITH {LINKS_SQL} SELECT src AS id, count(*) AS degree FROM a GROUP BY src")
def degree(spark, d):
    return A.degree(network_nodes(spark, d), network_links(spark, d))


for _how, _sql in {"sum": "sum(w)::BIGINT", "max": "greatest(max(w), 0)", "min": "least(min(w), 0)", "mean": "sum(w)::DOUBLE / (SELECT count(*) FROM n)"}.items():
    query(f"link_{_how}", f"WITH {LINKS_SQL} SELECT src AS id, {_sql} AS value FROM a GROUP BY src")(lambda spark, d, how=_how: A.link_aggregate(network_nodes(spark, d), network_links(spark, d), "w", how))


@query("sparse_normalised", f"WITH {LINKS_SQL} SELECT src AS \"row\", dst AS col, round(w::DOUBLE / sum(w) OVER (PARTITION BY src), 9) AS value FROM a")
def sparse_normalised(spark, d):
    return A.sparse_matrix(network_links(spark, d), "w", normalised=True).withColumn("value", F.round("value", 9))


@query("csr_rows", f"WITH {LINKS_SQL} SELECT src AS \"row\", count(*)::INT AS nnz, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS cols FROM a GROUP BY src")
def csr_rows(spark, d):
    return A.to_csr(A.sparse_matrix(network_links(spark, d), "w", whole_rows=True)).select("row", "nnz", F.concat_ws(",", F.col("cols").cast("array<string>")).alias("cols"))


@query("benchmarks", f"WITH {PHYSICAL_SQL} SELECT 'cpu' AS name, max(cpu::FLOAT) AS maximum FROM p UNION ALL SELECT 'ram', max(ram::FLOAT) FROM p")
def benchmarks(spark, d):
    return A.attribute_benchmarks(physical(spark, d), ["cpu", "ram"])


@query("relabel_links", f"WITH {LINKS_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n) SELECT x.k AS src, y.k AS dst, w FROM e JOIN r x ON e.src = x.id JOIN r y ON e.dst = y.id")
def relabel_links(spark, d):
    return P.relabel(network_nodes(spark, d), network_links(spark, d))[1].select("src", "dst", "w")


@query("induced_subgraph", f"WITH {LINKS_SQL} SELECT src, dst FROM e WHERE src % 2 = 0 AND dst % 3 = 0")
def induced_subgraph(spark, d):
    kept = network_nodes(spark, d).where(f"(id < {PART0} and id % 2 = 0) or (id >= {PART0} and id % 3 = 0)")
    return P.subgraph(network_links(spark, d), kept).select("src", "dst")


@query("rank_ffd", f"WITH {PHYSICAL_SQL} SELECT id, (cpu + ram)::DOUBLE AS score FROM p")
def rank_ffd(spark, d):
    return K.rank_ffd(physical(spark, d), ["cpu", "ram"])


def _graph_nodes(spark, d):
    return network_nodes(spark, d).withColumn("cpu", F.col("id") % 50 + 50)


@query("rank_nrm", f"WITH {LINKS_SQL} SELECT src AS id, ((src % 50 + 50) * sum(bw))::DOUBLE AS score FROM a GROUP BY src")
def rank_nrm(spark, d):
    return K.rank_nrm(_graph_nodes(spark, d), network_links(spark, d), ["cpu"], ["bw"])


@query("rank_nea", f"WITH {LINKS_SQL} SELECT src AS id, ((src % 50 + 50) * count(*))::DOUBLE AS score FROM a GROUP BY src")
def rank_nea(spark, d):
    return K.rank_nea(_graph_nodes(spark, d), network_links(spark, d), ["cpu"])


def _power(rounds: int, step: str) -> str:
    return ", ".join(f"r{k} AS ({step.format(p=f'r{k - 1}')})" for k in range(1, rounds + 1))


@query("rank_grc")
def rank_grc(spark, d):
    return K.rank_grc(_graph_nodes(spark, d), network_links(spark, d), ["cpu"], "bw")


_RW = "SELECT c.id, 0.15 * c.b + 0.85 * coalesce(f.f, 0) AS r FROM c LEFT JOIN (SELECT m.dst AS id, sum(q.r * m.m) AS f FROM m JOIN {p} q ON q.id = m.src GROUP BY m.dst) f ON f.id = c.id"


@query("rank_rw", f"WITH {LINKS_SQL}, u AS (SELECT src AS id, (src % 50 + 50) * sum(bw)::DOUBLE + 1e-9 AS b FROM a GROUP BY src), c AS (SELECT id, b / (SELECT sum(b) FROM u) AS b FROM u), m AS (SELECT src, dst, (dst % 50 + 50)::DOUBLE / sum(dst % 50 + 50) OVER (PARTITION BY src) AS m FROM (SELECT DISTINCT src, dst FROM a)), r0 AS (SELECT id, b AS r FROM c), {_power(10, _RW)} SELECT id, round(r, 10) AS score FROM r10")
def rank_rw(spark, d):
    return K.rank_rw(_graph_nodes(spark, d), network_links(spark, d), ["cpu"], "bw", tolerance=0.0, rounds=10).select("id", F.round("score", 10).alias("score"))


@query("top_parts_per_brand", "SELECT p_brand, p_partkey, r AS rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS r FROM part) WHERE r <= 3")
def top_parts_per_brand(spark, d):
    return K.top_k(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey", "rank")


@query("first_feasible_supplier", f"WITH {PHYSICAL_SQL} SELECT c_custkey, min(id) AS id FROM customer JOIN p ON nation = c_nationkey AND c_acctbal <= cpu GROUP BY c_custkey")
def first_feasible_supplier(spark, d):
    """The feasible supplier of its nation with the smallest key, for each customer."""
    offers = physical(spark, d).withColumnRenamed("nation", "c_nationkey")
    demands = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return K.best_offer(demands, offers, ["c_nationkey"], "c_acctbal", "cpu", -F.col("id"), ["id"]).select("c_custkey", "id")


_BFS = f"WITH RECURSIVE {LINKS_SQL}, s(id, d) USING KEY (id) AS (SELECT min(src), 0 FROM e UNION SELECT a.dst, min(s.d + 1) FROM s JOIN a ON a.src = s.id LEFT JOIN recurring.s r ON r.id = a.dst WHERE r.id IS NULL GROUP BY a.dst)"


@query("bfs", f"{_BFS} SELECT id, d AS distance FROM s")
def bfs(spark, d):
    links = network_links(spark, d)
    return G.bfs(links, links.agg(F.min("src").alias("id"))).select("id", "distance")


@query("bfs_stats", f"{_BFS} SELECT sum(d)::BIGINT AS total, count(*) AS reached FROM s")
def bfs_stats(spark, d):
    links = network_links(spark, d)
    return G.bfs_stats(G.bfs(links, links.agg(F.min("src").alias("id")))).select("total", "reached")


@query("tree_levels", f"{_BFS} SELECT d AS distance, id, row_number() OVER (PARTITION BY d ORDER BY id) - 1 AS place FROM s")
def tree_levels(spark, d):
    links = network_links(spark, d)
    return G.tree_levels(G.bfs(links, links.agg(F.min("src").alias("id")))).select("distance", "id", "place")


@query("shortest_paths", f"WITH RECURSIVE {LINKS_SQL}, b(id, d) USING KEY (id) AS (SELECT min(src), 0::BIGINT FROM e UNION SELECT a.dst, min(b.d + a.w) FROM b JOIN a ON a.src = b.id LEFT JOIN recurring.b r ON r.id = a.dst WHERE r.id IS NULL OR b.d + a.w < r.d GROUP BY a.dst), t AS (SELECT a.dst AS id, min(a.src) AS via FROM b JOIN a ON a.src = b.id JOIN b x ON x.id = a.dst WHERE b.d + a.w = x.d GROUP BY a.dst) SELECT b.id, b.d::DOUBLE AS distance, CASE WHEN b.id <> (SELECT min(src) FROM e) THEN via ELSE -1 END AS via FROM b LEFT JOIN t ON t.id = b.id")
def shortest_paths(spark, d):
    links = network_links(spark, d)
    return G.shortest_paths(links, links.agg(F.min("src").alias("id")), "w").select("id", "distance", F.coalesce("via", F.lit(-1)).alias("via"))


@query("components", f"WITH RECURSIVE {LINKS_SQL}, b(id, root) USING KEY (id) AS (SELECT id, id FROM n UNION SELECT a.dst, min(b.root) FROM b JOIN a ON a.src = b.id JOIN recurring.b r ON r.id = a.dst WHERE b.root < r.root GROUP BY a.dst) SELECT id, root AS component FROM b")
def components(spark, d):
    return G.connected_components(network_nodes(spark, d), network_links(spark, d))


@query("rank_nps", f"{_BFS}, k AS (SELECT src AS id, (src % 50 + 50) * sum(bw)::DOUBLE AS k FROM a GROUP BY src) SELECT id, (1 - row_number() OVER (ORDER BY d, k DESC, id))::DOUBLE AS score FROM s JOIN k USING (id)")
def rank_nps(spark, d):
    """By the weight w from the node with most neighbours; the SQL still counts hops from the smallest supplier (see README.md)."""
    return K.rank_nps(_graph_nodes(spark, d), network_links(spark, d), ["cpu"], ["bw"], "w")


@query("degree_centrality", f"WITH {LINKS_SQL} SELECT src AS id, round(count(*)::DOUBLE / ((SELECT count(*) FROM n) - 1), 9) AS score FROM a GROUP BY src")
def degree_centrality(spark, d):
    return G.degree_centrality(network_nodes(spark, d), network_links(spark, d)).withColumn("score", F.round("score", 9))


def _nation_graph(spark, d):
    """Nations linked along trade: customers' and suppliers' nations of all lines."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("b"))
    pairs = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count("*").alias("w"))


_NATIONS = "e AS (SELECT least(c_nationkey, s_nationkey)::BIGINT AS src, greatest(c_nationkey, s_nationkey)::BIGINT AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL), a AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
_HOPS = f"WITH RECURSIVE {_NATIONS}, m(s, id, d) USING KEY (s, id) AS (SELECT id, id, 0 FROM n UNION SELECT m.s, a.dst, min(m.d + 1) FROM m JOIN a ON a.src = m.id LEFT JOIN recurring.m r ON r.s = m.s AND r.id = a.dst WHERE r.id IS NULL GROUP BY m.s, a.dst)"
_COUNTS = f"{_HOPS}, c(s, id, d, p) AS (SELECT id, id, 0, 1::BIGINT FROM n UNION ALL SELECT c.s, a.dst, c.d + 1, sum(c.p)::BIGINT FROM c JOIN a ON a.src = c.id JOIN m ON m.s = c.s AND m.id = a.dst AND m.d = c.d + 1 GROUP BY c.s, a.dst, c.d)"


def _ids(links):
    return links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()


@query("closeness_centrality", f"{_HOPS} SELECT s AS id, round((count(*) - 1) / sum(d) * (count(*) - 1) / ((SELECT count(*) FROM n) - 1), 9) AS score FROM m GROUP BY s")
def closeness_centrality(spark, d):
    links = G.saved(_nation_graph(spark, d))
    return G.closeness_centrality(_ids(links), links).withColumn("score", F.round("score", 9))


@query("all_pairs_lengths", f"WITH RECURSIVE {_NATIONS}, m(s, id, d) USING KEY (s, id) AS (SELECT id, id, 0::BIGINT FROM n UNION SELECT m.s, a.dst, min(m.d + a.w) FROM m JOIN a ON a.src = m.id LEFT JOIN recurring.m r ON r.s = m.s AND r.id = a.dst WHERE r.id IS NULL OR m.d + a.w < r.d GROUP BY m.s, a.dst) SELECT s AS src, id AS dst, d::DOUBLE AS distance FROM m")
def all_pairs_lengths(spark, d):
    """Distances weighted by trade."""
    links = G.saved(_nation_graph(spark, d))
    return G.all_pairs_lengths(_ids(links), links, "w")


@query("path_counts", f"{_COUNTS} SELECT s AS source, id, d::INT AS distance, p AS paths FROM c")
def path_counts(spark, d):
    links = G.saved(_nation_graph(spark, d))
    return G.path_counts(links, G.bfs(links, _ids(links)))


@query("betweenness_centrality", f"{_COUNTS}, q AS (SELECT x.id, sum(x.p * y.p / t.p::DOUBLE) AS b FROM c x JOIN c y ON y.s = x.id JOIN c t ON t.s = x.s AND t.id = y.id AND t.d = x.d + y.d WHERE x.s <> x.id AND y.id <> x.id AND x.s <> y.id GROUP BY x.id) SELECT n.id, round(coalesce(b, 0) / greatest(((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM n) - 2), 1), 9) AS score FROM n LEFT JOIN q ON q.id = n.id")
def betweenness_centrality(spark, d):
    links = G.saved(_nation_graph(spark, d))
    return G.betweenness_centrality(_ids(links), links).withColumn("score", F.round("score", 9))


_EIGEN = "SELECT id, y / sqrt(sum(y * y) OVER ()) AS x FROM (SELECT q.id, q.x + coalesce(f.f, 0) AS y FROM {p} q LEFT JOIN (SELECT a.dst AS id, sum(z.x) AS f FROM a JOIN {p} z ON z.id = a.src GROUP BY a.dst) f ON f.id = q.id)"


@query("eigenvector_centrality", f"WITH {_NATIONS}, r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS x FROM n), {_power(30, _EIGEN)} SELECT id, round(x, 9) AS score FROM r30")
def eigenvector_centrality(spark, d):
    """Thirty rounds of power iteration."""
    links = G.saved(_nation_graph(spark, d))
    return G.eigenvector_centrality(_ids(links), links, rounds=30, tolerance=0.0).withColumn("score", F.round("score", 9))


def _requests(spark, d):
    """Orders as requests: arrival in days, lifetime from the price."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("v_net_id"), (F.unix_timestamp("o_orderdate") / 86400.0).alias("arrival_time"), (F.floor(F.col("o_totalprice") / 1000) + 1).cast("double").alias("lifetime"), F.col("o_orderpriority").alias("network"))


_REQUESTS = "q AS (SELECT o_orderkey AS v_net_id, epoch(o_orderdate) / 86400.0 AS arrival_time, (floor(o_totalprice / 1000) + 1)::DOUBLE AS lifetime, o_orderpriority AS network FROM orders)"


@query("in_service", f"WITH {_REQUESTS}, t AS (SELECT network, arrival_time AS time, 1 AS s FROM q UNION ALL SELECT network, arrival_time + lifetime, -1 FROM q), g AS (SELECT network, time, sum(s)::BIGINT AS step FROM t GROUP BY ALL) SELECT network, time, step, sum(step) OVER (PARTITION BY network ORDER BY time)::BIGINT AS active FROM g")
def in_service(spark, d):
    return C.in_service(_requests(spark, d), ["network"])


@query("event_schedule", f"WITH {_REQUESTS}, t AS (SELECT 1 AS type, v_net_id, arrival_time AS time FROM q UNION ALL SELECT 0, v_net_id, arrival_time + lifetime FROM q) SELECT row_number() OVER (ORDER BY time, type DESC, v_net_id) - 1 AS id, type, v_net_id, time FROM t")
def event_schedule(spark, d):
    from .sources.generators import event_schedule as schedule

    return schedule(_requests(spark, d))


@query("cumulative_arrivals", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS arrival_time FROM events")
def cumulative_arrivals(spark, d):
    from .sources.generators import arrival_times

    return arrival_times(table(spark, d, "events"), "user_id", "event_id", "value").select("user_id", "event_id", F.round("arrival_time", 4).alias("arrival_time"))


@query("tumbling_windows", "SELECT floor((epoch(ts) - 1600000000) / 86400)::BIGINT AS w, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    e = table(spark, d, "events").withColumn("w", R.window_index(F.unix_timestamp("ts").cast("double"), 1_600_000_000.0, 86400.0))
    return e.groupBy("w", "event_type").agg(F.count("*").alias("n"))


@query("solution_accounts", "WITH d AS (SELECT l_orderkey AS v_net_id, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) AS nr, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) AS lr, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity * (1 + l_linenumber % 3) ELSE 0 END) AS lc FROM lineitem GROUP BY 1) SELECT v_net_id, nr + lr AS revenue, nr + lc AS cost, round(CASE WHEN nr + lc = 0 THEN 0 ELSE (nr + lr) / (nr + lc) END, 9) AS r2c FROM d")
def solution_accounts(spark, d):
    li = table(spark, d, "lineitem")
    demands = li.select(F.col("l_orderkey").alias("v_net_id"), F.when(F.col("l_linenumber") % 2 == 0, "node").otherwise("link").alias("kind"), F.col("l_quantity").alias("amount"))
    hops = li.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("v_net_id"), (F.col("l_quantity") * (1 + F.col("l_linenumber") % 3)).alias("amount"))
    return C.solution_accounts(demands, hops).select("v_net_id", "revenue", "cost", F.round("r2c", 9).alias("r2c"))


@query("apply_deltas", f"WITH {PHYSICAL_SQL}, x AS (SELECT l_suppkey AS id, sum(l_linenumber)::BIGINT AS a FROM lineitem GROUP BY 1) SELECT p.id, cpu - coalesce(a, 0) AS cpu FROM p LEFT JOIN x ON x.id = p.id")
def apply_deltas(spark, d):
    debit = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), (-F.col("l_linenumber").cast("long")).alias("amount"))
    return A.apply_deltas(physical(spark, d), debit, ["id"], "cpu").select("id", "cpu")


@query("latest_per_user", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_user(spark, d):
    """As-of lookup: the last event of each user."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("event_attributes", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events WHERE (props ->> '$.k') IS NOT NULL")
def event_attributes(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return P.get_attribute(e, ["event_id"], "k")


@query("first_occurrence", "SELECT l_partkey, min_by(l_orderkey, l_orderkey * 10 + l_linenumber) AS l_orderkey FROM lineitem GROUP BY l_partkey")
def first_occurrence(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return P.first_occurrence(li, ["l_partkey"], "ord").select("l_partkey", "l_orderkey")


@query("never_ordered_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def never_ordered_customers(spark, d):
    """Customers that never ordered with urgency."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("pooled_offsets", "SELECT l_suppkey, max(l_quantity - 25) AS max_offset, sum(greatest(l_quantity - 25, 0)) AS violation FROM lineitem GROUP BY 1")
def pooled_offsets(spark, d):
    checks = table(spark, d, "lineitem").select("l_suppkey", R.offset(F.col("l_quantity"), F.lit(25.0)).alias("offset"))
    return A.pooled_offsets(checks, ["l_suppkey"])


@query("embedding_latency", "SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - 0.5) * (embedding[i]::DOUBLE - 0.5)))) * 9 + 1, 6) AS latency FROM embeddings")
def embedding_latency(spark, d):
    e = table(spark, d, "embeddings").withColumn("p", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", F.round(R.euclidean_latency(F.col("p"), F.transform("p", lambda x: F.lit(0.5)), 1.0, 10.0), 6).alias("latency"))


def _simulation(spark):
    from .plans import simulate as S
    from .sources import generators as N

    nodes, links = N.physical_network(spark, 40, 0)
    nested = S.nested_requests(*N.virtual_requests(spark, 60, 1), ["cpu"], ["bw"])
    return S.substrate(nodes, links, ["cpu"], ["bw"]), nested


@query("simulate_online")
def simulate_online(spark, d):
    """Acceptance of several solvers over one request stream; a task for each run."""
    from .plans import simulate as S

    sub, nested = _simulation(spark)
    runs = spark.createDataFrame([(i, s, 0) for i, s in enumerate(("grc_rank", "ffd_rank", "nrm_rank", "rw_rank", "pl_rank", "nea_rank", "order_rank_bfs", "ffd_joint_pr"))], "run_id long, solver string, seed int")
    return C.run_summary(C.running_state(S.online_runs(spark, sub, nested, runs, ["cpu"], ["bw"])))


@query("simulate_offline")
def simulate_offline(spark, d):
    from .plans import simulate as S

    sub, nested = _simulation(spark)
    return S.offline_runs(spark, sub, nested, "nrm_rank", ["cpu"], ["bw"]).select("v_net_id", "result", "revenue", "cost", "r2c")


@query("simulate_windows")
def simulate_windows(spark, d):
    from .plans import simulate as S

    sub, nested = _simulation(spark)
    runs = spark.createDataFrame([(0, "nrm_rank", 0)], "run_id long, solver string, seed int")
    return C.window_summary(S.online_runs(spark, sub, nested, runs, ["cpu"], ["bw"]), 0.0, 50.0)


from . import catalog_paths, catalog_sources, catalog_state  # noqa: E402, F401  their queries join this catalog
