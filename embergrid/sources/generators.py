"""Topology and request generators: columns for plain shapes, seeded driver streams where exactness counts."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import sample
from ..operators.running import running

LINKS = "src long, dst long"


def path_links(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def star_links(spark: SparkSession, leaves: int) -> DataFrame:
    return spark.range(leaves).select(F.lit(0).cast("long").alias("src"), (F.col("id") + 1).alias("dst"))


def grid_links(spark: SparkSession, rows: int, columns: int, periodic: bool = False) -> DataFrame:
    """Down and right neighbours; only dimensions of three or more close."""
    cell = spark.range(rows * columns).select("id", F.floor(F.col("id") / columns).alias("r"), (F.col("id") % columns).alias("c"))
    down = cell.where(F.col("r") < rows - 1).select(F.col("id").alias("src"), (F.col("id") + columns).alias("dst"))
    right = cell.where(F.col("c") < columns - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    out = down.union(right)
    if periodic and rows >= 3:
        out = out.union(cell.where("r = 0").select(F.col("id").alias("src"), (F.col("id") + (rows - 1) * columns).alias("dst")))
    if periodic and columns >= 3:
        out = out.union(cell.where("c = 0").select(F.col("id").alias("src"), (F.col("id") + columns - 1).alias("dst")))
    return out


def random_links(n: int, p: float, rng: random.Random, directed: bool = False) -> list[tuple[int, int]]:
    """One draw for each pair in lexicographic order."""
    return [(i, j) for i in range(n) for j in range(0 if directed else i + 1, n) if i != j and rng.random() < p]


def waxman(n: int, beta: float, alpha: float, rng: random.Random) -> tuple[dict[int, tuple[float, float]], list[tuple[int, int]]]:
    """Positions in the unit square, and links with probability beta exp(-d / (alpha L))."""
    if n < 2:
        raise ValueError("two nodes are needed")
    at = {i: (rng.random(), rng.random()) for i in range(n)}
    pairs = [(i, j, math.dist(at[i], at[j])) for i in range(n) for j in range(i + 1, n)]
    longest = max(d for *_, d in pairs)
    return at, [(i, j) for i, j, d in pairs if rng.random() < beta * math.exp(-d / (alpha * longest))]


def is_connected(n: int, links: list[tuple[int, int]]) -> bool:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in links:
        parent[root(u)] = root(v)
    return len({root(x) for x in range(n)}) <= 1


def connected_retry(make: Callable[[], list], n: int, attempts: int = 1000) -> list:
    """Draws from the same stream until the graph is connected."""
    for _ in range(attempts):
        links = make()
        if is_connected(n, links):
            return links
    raise RuntimeError("no connected graph was drawn")


def topology(kind: str, size: int, rng: random.Random, **options) -> list[tuple[int, int]]:
    """Links by kind: path, star, grid_2d, waxman or random. Waxman's settings cross over: its alpha
    setting is the generator's beta and the other way round, as existing settings expect."""
    if kind == "path":
        return [(i, i + 1) for i in range(size - 1)]
    if kind == "star":
        return [(0, i) for i in range(1, size)]
    if kind == "grid_2d":
        m, k = options["m"], options["n"]
        return [(r * k + c, (r + 1) * k + c) for r in range(m - 1) for c in range(k)] + [(r * k + c, r * k + c + 1) for r in range(m) for c in range(k - 1)]
    if kind == "waxman":
        return connected_retry(lambda: waxman(size, options.get("wm_alpha", 0.5), options.get("wm_beta", 0.2), rng)[1], size)
    if kind == "random":
        return connected_retry(lambda: random_links(size, options.get("random_prob", 0.5), rng), size)
    raise ValueError(f"unknown topology {kind!r}")


def links_frame(spark: SparkSession, links: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(links)], "eid long, " + LINKS)


def physical_network(spark: SparkSession, n: int, seed: int, kind: str = "waxman", low: int = 50, high: int = 100, **options) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) with capacities and copies of their initial values."""
    rng, stream = random.Random(seed), np.random.RandomState(seed)
    links = topology(kind, n, rng, **options)
    cpu, bw = sample(stream, n, "uniform", "int", low, high), sample(stream, len(links), "uniform", "int", low, high)
    nodes = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cpu)], "id long, cpu long").withColumn("max_cpu", F.col("cpu"))
    edges = spark.createDataFrame([(i, u, v, int(b)) for i, ((u, v), b) in enumerate(zip(links, bw))], "eid long, src long, dst long, bw long").withColumn("max_bw", F.col("bw"))
    return nodes, edges


def virtual_requests(spark: SparkSession, count: int, seed: int, rate: float = 0.16, lifetime: float = 500.0, sizes: tuple[int, int] = (2, 10), p: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, nodes, links): sizes, lifetimes and inter-arrival times in this draw order."""
    rng, stream = random.Random(seed), np.random.RandomState(seed)
    n = sample(stream, count, "uniform", "int", *sizes)
    life = sample(stream, count, "exponential", scale=lifetime)
    arrival = np.cumsum(sample(stream, count, "poisson", "float", lam=1 / rate))
    nodes, links = [], []
    for i in range(count):
        own = topology("random", int(n[i]), rng, random_prob=p)
        nodes += [(i, k, int(c)) for k, c in enumerate(sample(stream, int(n[i]), "uniform", "int", 0, 20))]
        links += [(i, u, v, int(b)) for (u, v), b in zip(own, sample(stream, len(own), "uniform", "int", 0, 50))]
    requests = spark.createDataFrame([(i, float(a), float(x), int(k)) for i, (a, x, k) in enumerate(zip(arrival, life, n))], "v_net_id long, arrival_time double, lifetime double, num_nodes int")
    return requests, spark.createDataFrame(nodes, "v_net_id long, id long, cpu long"), spark.createDataFrame(links, "v_net_id long, src long, dst long, bw long")


def event_schedule(requests: DataFrame) -> DataFrame:
    """Arrivals, then leaves, sorted stably by time alone; dense ids by range partitions."""
    from ..operators.attributes import with_position

    arrivals = requests.select(F.lit(1).alias("type"), "v_net_id", F.col("arrival_time").alias("time"))
    leaves = requests.select(F.lit(0).alias("type"), "v_net_id", (F.col("arrival_time") + F.col("lifetime")).alias("time"))
    return with_position(arrivals.unionAll(leaves), [F.col("time").asc(), F.col("type").desc(), F.col("v_net_id").asc()], "id").select("id", "type", "v_net_id", "time")


def arrival_times(intervals: DataFrame, key: str, order: str, interval: str) -> DataFrame:
    """Running sums of inter-arrival times per key; a hot key runs in ranges."""
    return running(intervals, [key], [order], {"arrival_time": F.col(interval)})
