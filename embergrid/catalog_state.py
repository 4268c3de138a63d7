"""More queries of the catalog: accounts, recorder state, predicates, updates, paths and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import LINKS_SQL, PART0, PHYSICAL_SQL, network_links, network_nodes, physical, query, table
from .functions import resources as R
from .operators import aggregates as A
from .operators import attributes as P
from .operators import graph as G
from .operators import ranking as K
from .plans import accounting as C
from .streaming import events as E

_ACCOUNTS = "d AS (SELECT l_orderkey AS v_net_id, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) AS nr, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) AS lr, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity * (1 + l_linenumber % 3) ELSE 0 END) AS lc FROM lineitem GROUP BY 1)"


def _lines(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("v_net_id"), "l_linenumber", F.col("l_quantity").alias("amount"))


@query("full_accounts", f"WITH {_ACCOUNTS}, s AS (SELECT o_orderkey AS v_net_id, o_orderstatus <> 'P' AS result, (1 + o_custkey % 10)::DOUBLE AS lifetime FROM orders) SELECT v_net_id, CASE WHEN result THEN nr + lr ELSE 0 END AS revenue, CASE WHEN result THEN nr + lc ELSE 0 END AS cost, nr + lr AS v_net_demand, CASE WHEN result THEN nr + lr ELSE 0 END * lifetime AS time_revenue, CASE WHEN result THEN nr + lc ELSE 0 END * lifetime AS time_cost FROM d JOIN s USING (v_net_id)")
def full_accounts(spark, d):
    lines = _lines(spark, d)
    demands = lines.select("v_net_id", F.when(F.col("l_linenumber") % 2 == 0, "node").otherwise("link").alias("kind"), "amount")
    hops = lines.where("l_linenumber % 2 = 1").select("v_net_id", (F.col("amount") * (1 + F.col("l_linenumber") % 3)).alias("amount"))
    solved = table(spark, d, "orders").select(F.col("o_orderkey").alias("v_net_id"), (F.col("o_orderstatus") != "P").alias("result"), (1 + F.col("o_custkey") % 10).cast("double").alias("lifetime"))
    return C.full_accounts(C.solution_accounts(demands, hops), solved).select("v_net_id", "revenue", "cost", "v_net_demand", "time_revenue", "time_cost")


@query("partial_accounts", f"WITH {_ACCOUNTS} SELECT v_net_id, nr + lr AS revenue, nr + lc AS cost, round(CASE WHEN nr + lc = 0 THEN 0 ELSE (nr + lr) / (nr + lc) END, 9) AS r2c FROM d")
def partial_accounts(spark, d):
    lines = _lines(spark, d)
    placed = lines.where("l_linenumber % 2 = 0").select("v_net_id", "amount")
    routed = lines.where("l_linenumber % 2 = 1").select("v_net_id", "amount", (1 + F.col("l_linenumber") % 3).alias("hops"))
    return C.partial_accounts(placed, routed).select("v_net_id", "revenue", "cost", F.round("r2c", 9).alias("r2c"))


@query("utilisation", f"WITH {PHYSICAL_SQL} SELECT id, round(1 - (cpu - ram / 100.0) / cpu, 9) AS used FROM p")
def utilisation(spark, d):
    return physical(spark, d).select("id", F.round(R.utilisation(F.col("cpu") - F.col("ram") / 100, F.col("cpu")), 9).alias("used"))


@query("admission", "SELECT c_custkey, NOT (-c_acctbal > 0) AND NOT (c_acctbal / 10000 < 0.3 AND c_custkey > 100) AS ok FROM customer")
def admission(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", R.admitted(-F.col("c_acctbal"), F.col("c_acctbal") / 10000, F.col("c_custkey"), 0.3, 100).alias("ok"))


@query("path_predicates", "SELECT vec_id, 3.0 >= list_sum(list_transform(embedding, lambda x: abs(x)::DOUBLE)) AS fits, round(list_sum(list_transform(embedding, lambda x: greatest(x::DOUBLE, 0))), 9) AS violation, len(list_filter(embedding, lambda x: x >= 0.5)) = 0 AS hops_ok, least(greatest(embedding[1], -0.05::FLOAT), 0.05::FLOAT) AS clipped FROM embeddings")
def path_predicates(spark, d):
    """The components of a vector as latencies and offsets along a path."""
    e = table(spark, d, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    hops = R.path_ok(F.transform(x, lambda v: v < 0.5))
    clipped = R.clip(F.col("embedding")[0], F.lit(-0.05).cast("float"), F.lit(0.05).cast("float"))
    return e.select("vec_id", R.path_latency_ok(F.transform(x, F.abs), F.lit(3.0)).alias("fits"), F.round(R.violation(x), 9).alias("violation"), hops.alias("hops_ok"), clipped.alias("clipped"))


@query("link_check", f"WITH {LINKS_SQL} SELECT src, dst, bw >= 2 AND w <= 3 AS ok, 2 - bw AS bw_offset, w - 3 AS w_offset FROM e")
def link_check(spark, d):
    two, three = F.lit(2).cast("long"), F.lit(3).cast("long")
    ok, offsets = R.check({"bw": (two, F.col("bw")), "w": (F.col("w"), three)})
    return network_links(spark, d).select("src", "dst", ok.alias("ok"), offsets.alias("o")).select("src", "dst", "ok", F.col("o.bw").alias("bw_offset"), F.col("o.w").alias("w_offset"))


_RECORDS = "r AS (SELECT user_id % 7 AS run_id, event_id, (event_id % 3 <> 0)::INT AS event_type, epoch(ts)::DOUBLE AS event_time, value >= 20 AS result, value >= 10 AS place_result, value >= 20 AS route_result, floor(value) AS revenue, floor(value) + event_id % 5 AS cost, 1 + event_id % 4 AS lifetime, 1000 - event_id % 50 AS available FROM events)"


def _records(spark, d):
    """Events as a recorder's rows: two arrivals to a leave, accepted by their value."""
    i, v = F.col("event_id"), F.col("value")
    cost = F.floor(v) + i % 5
    return table(spark, d, "events").select(
        (F.col("user_id") % 7).alias("run_id"), "event_id", (i % 3 != 0).cast("int").alias("event_type"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"),
        (v >= 20).alias("result"), (v >= 10).alias("place_result"), (v >= 20).alias("route_result"), F.floor(v).cast("double").alias("revenue"), cost.cast("double").alias("cost"),
        (F.floor(v) / F.nullif(cost, F.lit(0))).alias("r2c"), (1 + i % 4).cast("double").alias("lifetime"), (1000 - i % 50).cast("double").alias("available"),
    ).withColumn("event_time", F.col("us") / 1e6).drop("us")


_STATE = f"{_RECORDS}, t AS (SELECT *, sum(event_type) OVER w AS v_net_count, sum((event_type = 1 AND result)::INT) OVER w AS success_count, sum((event_type = 1 AND result)::INT - (event_type = 0 AND result)::INT) OVER w AS inservice_count, sum(CASE WHEN event_type = 1 AND result THEN revenue ELSE 0 END) OVER w AS total_revenue, sum(CASE WHEN event_type = 1 AND result THEN cost ELSE 0 END) OVER w AS total_cost FROM r WINDOW w AS (PARTITION BY run_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))"


@query("running_state", f"WITH {_STATE} SELECT run_id, event_id, v_net_count::BIGINT AS v_net_count, success_count::BIGINT AS success_count, inservice_count::BIGINT AS inservice_count, total_revenue::DOUBLE AS total_revenue, total_cost::DOUBLE AS total_cost FROM t")
def running_state(spark, d):
    return C.running_state(_records(spark, d)).select("run_id", "event_id", "v_net_count", "success_count", "inservice_count", "total_revenue", "total_cost")


@query("run_summary", f"WITH {_STATE} SELECT run_id, round(arg_max(success_count, event_id) / arg_max(v_net_count, event_id), 9) AS acceptance_rate, arg_max(v_net_count, event_id)::BIGINT AS v_net_count, arg_max(total_revenue, event_id)::DOUBLE AS total_revenue, round(arg_max(total_revenue, event_id) / arg_max(event_time, event_id), 12) AS long_term_revenue, max(inservice_count)::BIGINT AS max_inservice, min(available)::DOUBLE AS min_available, count(*) FILTER (event_type = 1 AND NOT place_result) AS place_failures, count(*) FILTER (event_type = 1 AND place_result AND NOT route_result) AS route_failures FROM t GROUP BY run_id")
def run_summary(spark, d):
    out = C.run_summary(C.running_state(_records(spark, d)))
    return out.select("run_id", F.round("acceptance_rate", 9).alias("acceptance_rate"), "v_net_count", "total_revenue", F.round("long_term_revenue", 12).alias("long_term_revenue"), "max_inservice", "min_available", "place_failures", "route_failures")


@query("window_summary", f"WITH {_RECORDS}, x AS (SELECT *, CASE WHEN event_type = 1 THEN floor((event_time - 1600000000) / 86400)::BIGINT END AS own FROM r), y AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS w FROM x) SELECT run_id, w AS \"window\", count(*) FILTER (event_type = 1) AS arrival_steps, count(*) FILTER (event_type = 1 AND result) AS accepted, count(*) FILTER (event_type = 1 AND NOT result) AS rejected, count(*) FILTER (event_type <> 1) AS auto_released_events FROM y WHERE w IS NOT NULL GROUP BY ALL")
def window_summary(spark, d):
    return C.window_summary(_records(spark, d), 1_600_000_000.0, 86400.0).select("run_id", "window", "arrival_steps", "accepted", "rejected", "auto_released_events")


@query("running_membership", f"WITH s AS (SELECT l_linenumber AS run_id, l_orderkey AS event_id, l_suppkey AS p_node, 1 AS step FROM lineitem UNION ALL SELECT l_linenumber, l_orderkey + 100, l_suppkey, -1 FROM lineitem), g AS (SELECT run_id, p_node, event_id, sum(step) AS step FROM s GROUP BY ALL), h AS (SELECT *, sum(step) OVER (PARTITION BY run_id, p_node ORDER BY event_id) AS held FROM g), t AS (SELECT run_id, event_id, sum((held > 0)::INT - (held - step > 0)::INT) AS turn FROM h GROUP BY ALL) SELECT run_id, event_id, sum(turn) OVER (PARTITION BY run_id ORDER BY event_id)::BIGINT AS running_nodes FROM t")
def running_membership(spark, d):
    """Suppliers in use while an order and the hundred after it are in service, a run for each line number."""
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("run_id"), F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("p_node"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("later"), F.lit(1).alias("step")), F.struct(F.lit(100).alias("later"), F.lit(-1).alias("step")))).alias("x")
    steps = li.select("run_id", "event_id", "p_node", ends)
    return C.running_membership(steps.select("run_id", (F.col("event_id") + F.col("x.later")).alias("event_id"), "p_node", F.col("x.step").alias("step")))


@query("concatenated_stages", "SELECT o_orderkey, (o_custkey % 3)::BIGINT AS epoch, 0 AS stage FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, (o_custkey % 3)::BIGINT + 3, 1 FROM orders WHERE o_orderstatus <> 'F'")
def concatenated_stages(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 3).alias("epoch"))
    return C.concatenate_stages([o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")], [0, 3]).select("o_orderkey", "epoch", "stage")


@query("set_attribute", f"WITH {PHYSICAL_SQL}, x AS (SELECT l_suppkey AS id, count(*) AS cpu FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT p.id, coalesce(x.cpu, p.cpu) AS cpu FROM p LEFT JOIN x ON x.id = p.id")
def set_attribute(spark, d):
    new = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("cpu"))
    return P.set_attribute(physical(spark, d), ["id"], "cpu", new).select("id", "cpu")


@query("adjacency_lists", f"WITH {LINKS_SQL} SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbours FROM a GROUP BY src")
def adjacency_lists(spark, d):
    return P.adjacency_lists(network_links(spark, d)).select("src", F.concat_ws(",", F.col("neighbours").cast("array<string>")).alias("neighbours"))


@query("incident_links", f"WITH {LINKS_SQL} SELECT src, dst, w FROM e WHERE src IN (1, 2, 3)")
def incident_links(spark, d):
    return P.incident(network_links(spark, d), [1, 2, 3]).select("src", "dst", "w")


@query("edges_between", f"WITH {LINKS_SQL}, q AS (SELECT DISTINCT l_partkey + {PART0} AS src, l_suppkey % 5 + 1 AS dst FROM lineitem) SELECT q.src, q.dst, a.src IS NOT NULL AS linked, coalesce(a.w, -1) AS w FROM q LEFT JOIN a ON a.src = q.src AND a.dst = q.dst")
def edges_between(spark, d):
    pairs = table(spark, d, "lineitem").select((F.col("l_partkey") + PART0).alias("src"), (F.col("l_suppkey") % 5 + 1).alias("dst")).distinct()
    return P.edges_between(network_links(spark, d), pairs).select("src", "dst", F.col("w").isNotNull().alias("linked"), F.coalesce("w", F.lit(-1)).alias("w"))


@query("removed_nodes", f"WITH {LINKS_SQL} SELECT src, dst FROM e WHERE src % 3 <> 0")
def removed_nodes(spark, d):
    nodes = network_nodes(spark, d)
    return P.remove_nodes(nodes, network_links(spark, d), nodes.where(f"id < {PART0} and id % 3 = 0"))[1].select("src", "dst")


@query("added_links", f"WITH {LINKS_SQL}, f AS (SELECT DISTINCT l_suppkey AS src, l_orderkey + 2 * {PART0} AS dst FROM lineitem WHERE l_returnflag = 'N') SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst FROM e UNION ALL SELECT (SELECT count(*) FROM e) + row_number() OVER (ORDER BY src, dst) - 1, src, dst FROM f")
def added_links(spark, d):
    new = table(spark, d, "lineitem").where("l_returnflag = 'N'").select((F.col("l_orderkey") + 2 * PART0).alias("src"), F.col("l_suppkey").alias("dst"))
    links = P.with_position(network_links(spark, d).select("src", "dst"), [F.col("src"), F.col("dst")], "eid")
    return P.add_edges(links, new.union(links.select("src", "dst"))).select("eid", "src", "dst")


@query("flattened_props", "SELECT event_id, 'k' AS \"key\", props ->> '$.k' AS value FROM events WHERE (props ->> '$.k') IS NOT NULL")
def flattened_props(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("props"))
    return P.flatten(e, "props", ["event_id"])


@query("path_costs", f"WITH {LINKS_SQL}, t AS (SELECT dst AS path_id, min(src) AS lo, max(src) AS hi FROM e GROUP BY dst), h AS (SELECT path_id, 0 AS hop, lo AS src, path_id AS dst FROM t WHERE lo < hi UNION ALL SELECT path_id, 1, path_id, hi FROM t WHERE lo < hi) SELECT path_id, hop, h.src, h.dst, sum(w) OVER (PARTITION BY path_id ORDER BY hop)::BIGINT AS prefix FROM h JOIN a ON a.src = h.src AND a.dst = h.dst")
def path_costs(spark, d):
    """From a part's first supplier over the part to its last."""
    links = network_links(spark, d)
    ends = links.groupBy(F.col("dst").alias("path_id")).agg(F.min("src").alias("lo"), F.max("src").alias("hi")).where("lo < hi")
    paths = ends.select("path_id", F.array("lo", "path_id", "hi").alias("path"))
    return G.path_costs(paths, links, "w").withColumn("prefix", F.col("prefix").cast("long"))


@query("rank_links_ffd", f"WITH {LINKS_SQL} SELECT src, dst, (w + bw)::DOUBLE AS score FROM e")
def rank_links_ffd(spark, d):
    links = network_links(spark, d).withColumn("eid", F.lit(0))
    return K.rank_links(links, "ffd", ["w", "bw"]).select("src", "dst", "score")


@query("rank_order", f"WITH {LINKS_SQL} SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS score FROM n")
def rank_order(spark, d):
    return K.rank_order(network_nodes(spark, d))


@query("relabel_by_degree", f"WITH {LINKS_SQL}, g AS (SELECT src AS id, count(*) AS k FROM a GROUP BY src), r AS (SELECT id, row_number() OVER (ORDER BY k DESC, id) - 1 AS new_id FROM g) SELECT id, new_id FROM r")
def relabel_by_degree(spark, d):
    links = network_links(spark, d)
    nodes = A.degree(network_nodes(spark, d), links)
    return P.relabel(nodes, links, [F.col("degree").desc(), F.col("id").asc()])[0].select("id", "new_id")


@query("path_score", "SELECT l_partkey, round(sum(l_quantity) / (sum(l_linenumber) + 1e-6), 9) AS score FROM lineitem GROUP BY 1")
def path_score(spark, d):
    li = table(spark, d, "lineitem")
    total = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("nrm"))
    scored = K.path_score(li.join(total, "l_partkey"), "nrm", "l_linenumber", ["l_partkey"])
    return scored.select("l_partkey", F.round("score", 9).alias("score"))


@query("nearby_score", "SELECT l_partkey, round(count(*) / (1 + sum(l_linenumber)) * (2 + sum(l_quantity / (l_linenumber + 1e-6))), 6) AS score FROM lineitem GROUP BY 1")
def nearby_score(spark, d):
    li = table(spark, d, "lineitem")
    total = li.groupBy("l_partkey").agg(F.count("*").alias("k"))
    return K.nearby_score(li.join(total, "l_partkey"), "k", "l_linenumber", "l_quantity", ["l_partkey"]).select("l_partkey", F.round("score", 6).alias("score"))


@query("duplicate_targets", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_targets(spark, d):
    return A.duplicate_targets(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("network_size", f"WITH {LINKS_SQL} SELECT (SELECT count(*) FROM n) AS num_nodes, (SELECT count(*) FROM e) AS num_edges")
def network_size(spark, d):
    return A.network_size(network_nodes(spark, d), network_links(spark, d))


@query("attribute_extrema", f"WITH {PHYSICAL_SQL} SELECT 'cpu' AS name, max((cpu + ram)::FLOAT) AS maximum FROM p")
def attribute_extrema(spark, d):
    return A.attribute_extrema(physical(spark, d).withColumn("max_cpu", F.col("cpu") + F.col("ram")), {"cpu": "max_cpu"})


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS \"count\" FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return E.windowed_counts(table(spark, d, "events"), "1 hour", "10 minutes")


@query("sliding_counts", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, count(*) AS \"count\" FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL")
def sliding_counts(spark, d):
    return E.sliding_counts(table(spark, d, "events"), "1 hour", "30 minutes", "10 minutes")


@query("session_counts", "WITH g AS (SELECT user_id, ts, (ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL)::INT AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS \"count\" FROM s GROUP BY user_id, k")
def session_counts(spark, d):
    return E.session_counts(table(spark, d, "events"), "6 hours", "10 minutes")


@query("skipping_nan", "SELECT l_suppkey, round(avg(CASE WHEN l_linenumber <> 3 THEN l_quantity END), 9) AS mean, sum(CASE WHEN l_linenumber <> 3 THEN l_quantity ELSE 0 END) AS total, min(CASE WHEN l_linenumber <> 3 THEN l_quantity END) AS least FROM lineitem GROUP BY 1")
def skipping_nan(spark, d):
    x = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(R.mean_skip_nan(x), 9).alias("mean"), R.sum_skip_nan(x).alias("total"), R.min_skip_nan(x).alias("least"))


@query("safe_subtract", f"WITH {PHYSICAL_SQL} SELECT id, (cpu - least(ram, cpu))::DOUBLE AS free, cpu + ram AS more FROM p")
def safe_subtract(spark, d):
    p = physical(spark, d)
    return p.select("id", R.subtract(F.col("cpu"), F.least("ram", "cpu"), "cpu").alias("free"), R.add(F.col("cpu"), F.col("ram")).alias("more"))
