"""Simulation runs as grouped kernels: independent runs, seeds, solvers or requests scale out.

The event loop of one run is sequential by nature and is one group; the physical network, a few
thousand nodes at most, travels with the function.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embedding import Request, Substrate, run_offline, run_online

MAX_SUBSTRATE_ROWS = 1_000_000
RECORD = "run_id long, solver string, event_id long, event_type int, event_time double, v_net_id long, result boolean, place_result boolean, route_result boolean, revenue double, cost double, r2c double, lifetime double, node_slots map<long,long>, available double"


def substrate(nodes: DataFrame, links: DataFrame, resources: Sequence[str], bandwidths: Sequence[str]) -> Substrate:
    """The physical network on the driver, behind a check of its size."""
    n, m = nodes.limit(MAX_SUBSTRATE_ROWS + 1).count(), links.limit(MAX_SUBSTRATE_ROWS + 1).count()
    if max(n, m) > MAX_SUBSTRATE_ROWS:
        raise ValueError("the physical network is too large for one task")
    own = {r["id"]: {c: r[c] for c in resources} for r in nodes.select("id", *resources).orderBy("id").collect()}
    edges = {(min(r["src"], r["dst"]), max(r["src"], r["dst"])): {c: r[c] for c in bandwidths} for r in links.select("src", "dst", *bandwidths).orderBy("src", "dst").collect()}
    return Substrate(own, edges)


def nested_requests(requests: DataFrame, v_nodes: DataFrame, v_links: DataFrame, resources: Sequence[str], bandwidths: Sequence[str]) -> DataFrame:
    """A row for each request with its nodes and links as arrays; a request without nodes is an error."""
    n = v_nodes.groupBy("v_net_id").agg(F.array_sort(F.collect_list(F.struct("id", *resources))).alias("nodes"))
    e = v_links.groupBy("v_net_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", *bandwidths))).alias("links"))
    none = F.raise_error(F.concat(F.lit("a request without nodes: "), F.col("v_net_id").cast("string")))
    out = requests.join(n, "v_net_id", "left").join(e, "v_net_id", "left")
    return out.withColumn("nodes", F.coalesce("nodes", none.cast(n.schema["nodes"].dataType)))


def _request(row, resources, bandwidths) -> Request:
    links = row.links if row.links is not None else []
    return Request(int(row.v_net_id), {int(x["id"]): {c: x[c] for c in resources} for x in row.nodes}, {(int(x["src"]), int(x["dst"])): {c: x[c] for c in bandwidths} for x in links}, float(row.arrival_time), float(row.lifetime))


def _frame(rows: list[dict], run_id: int, solver: str) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    out.insert(0, "run_id", run_id)
    out.insert(1, "solver", solver)
    return out[[c.split()[0] for c in RECORD.split(", ")]]


def online_runs(spark: SparkSession, physical: Substrate, nested: DataFrame, runs: DataFrame, resources: Sequence[str], bandwidths: Sequence[str]) -> DataFrame:
    """The records of every run (run_id, solver, seed) over all requests, a task for each run."""
    shared = spark.sparkContext.broadcast(physical)
    every = nested.select("v_net_id", "arrival_time", "lifetime", "nodes", "links")
    stated = F.array(*[F.struct(F.lit(int(r["run_id"])).cast("long").alias("run_id"), F.lit(r["solver"]).alias("solver"), F.lit(int(r["seed"])).alias("seed")) for r in runs.collect()])
    rows = every.withColumn("r", F.explode(stated)).select("*", "r.*").drop("r")  # a stated, short list of runs

    def simulate(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["arrival_time", "v_net_id"])
        own = [_request(r, resources, bandwidths) for r in group.itertuples()]
        first = group.iloc[0]
        return _frame(run_online(shared.value.copy(), own, first["solver"], int(first["seed"])), int(first["run_id"]), first["solver"])

    return rows.groupBy("run_id").applyInPandas(simulate, RECORD)


def offline_runs(spark: SparkSession, physical: Substrate, nested: DataFrame, solver: str, resources: Sequence[str], bandwidths: Sequence[str], seed: int = 0) -> DataFrame:
    """Every request on the untouched network; no shuffle, any number of tasks."""
    shared = spark.sparkContext.broadcast(physical)

    def solve(batches):
        for batch in batches:
            rows = [run_offline(shared.value, _request(r, resources, bandwidths), solver, seed) for r in batch.itertuples()]
            if rows:
                yield _frame(rows, 0, solver)

    return nested.select("v_net_id", "arrival_time", "lifetime", "nodes", "links").mapInPandas(solve, RECORD)
