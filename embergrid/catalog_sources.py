"""Queries that write tables in a format of the library, read them back and return what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, table
from .operators.attributes import with_position
from .operators.storage import folder
from .sources import datasets, files

_SHARED = "x AS (SELECT DISTINCT l_orderkey AS o, s_suppkey AS s, s_nationkey AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def _networks(spark, d):
    """A network for each nation: its suppliers, linked where they serve the same orders."""
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("network")
    nodes = s.select(name, F.col("s_suppkey").alias("id"), (F.floor("s_acctbal") + 2000).alias("cpu"), F.col("s_name").alias("name"))
    served = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    served = served.join(nodes.select(F.col("id").alias("s"), "network"), "s")
    pairs = served.join(served.withColumnRenamed("s", "t"), ["o", "network"]).where("s < t")
    return nodes, pairs.groupBy("network", F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.count("*").alias("bw"))


def _read_back(spark, d):
    path = folder(spark, "networks")
    datasets.write_networks(*_networks(spark, d), path)
    return datasets.read_networks(spark, path, {"cpu": "long", "name": "string"}, {"bw": "long"})


@query("dataset_nodes", "SELECT 'n' || s_nationkey AS network, s_suppkey AS id, floor(s_acctbal)::BIGINT + 2000 AS cpu, s_name AS name FROM supplier")
def dataset_nodes(spark, d):
    return _read_back(spark, d)[0]


@query("dataset_links", f"WITH {_SHARED} SELECT 'n' || a.n AS network, a.s AS src, b.s AS dst, count(*) AS bw FROM x a JOIN x b ON a.o = b.o AND a.n = b.n AND a.s < b.s GROUP BY ALL")
def dataset_links(spark, d):
    return _read_back(spark, d)[1].drop("eid")


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_round_trip(spark, d):
    """Customers as text cells and back, with the types checked."""
    path = folder(spark, "customers")
    files.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    kinds = dict(table(spark, d, "customer").dtypes)
    return files.typed(files.read_csv(spark, path), {c: kinds[c] for c in ("c_custkey", "c_nationkey", "c_acctbal")})


@query("request_dataset", "WITH q AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS v_net_id, s_suppkey FROM supplier), f AS (SELECT l_suppkey AS s_suppkey, epoch(min(l_shipdate)) / 86400.0 AS a, epoch(max(l_shipdate)) / 86400.0 + 1 AS b FROM lineitem GROUP BY 1), t AS (SELECT 1 AS type, v_net_id, a AS time FROM q JOIN f USING (s_suppkey) UNION ALL SELECT 0, v_net_id, b FROM q JOIN f USING (s_suppkey)) SELECT row_number() OVER (ORDER BY time, type DESC, v_net_id) - 1 AS id, type, v_net_id, time FROM t")
def request_dataset(spark, d):
    """Suppliers as requests from their first to their last shipment, saved with a network each, loaded and checked: the events."""
    from .sources.generators import event_schedule

    at = with_position(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), [F.col("s_suppkey")], "v_net_id")
    days = lambda f: F.unix_timestamp(f("l_shipdate").cast("timestamp")) / 86400.0
    spans = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(days(F.min).alias("arrival_time"), (days(F.max) + 1).alias("end"))
    requests = at.join(spans, "s_suppkey").withColumn("lifetime", F.col("end") - F.col("arrival_time"))
    nodes = requests.select("v_net_id", F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 1)])).alias("id"), F.col("s_nationkey").cast("long").alias("cpu"))
    links = requests.select("v_net_id", F.lit(0).cast("long").alias("eid"), F.lit(0).cast("long").alias("src"), F.lit(1).cast("long").alias("dst"), F.col("s_nationkey").cast("long").alias("bw"))
    path = folder(spark, "requests")
    datasets.save_requests(nodes, links, event_schedule(requests), path)
    return datasets.load_requests(spark, path, {"cpu": "long"}, {"bw": "long"})[2]
