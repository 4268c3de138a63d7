"""Node and link rankings, top-k and first-feasible selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import degree, link_aggregate
from .attributes import closure, with_position
from .graph import arcs_of, least_distances
from .running import running
from .storage import dealt, saved
from .tiles import Tiles


MAX_DRAWN = 1_000_000


def _total(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n) for n in names], F.lit(0))


def rank_order(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.lit(1.0 / max(nodes.count(), 1)).alias("score"))


def rank_random(nodes: DataFrame, rng: np.random.RandomState) -> DataFrame:
    """Shuffled positions, exact with numpy's legacy stream, whose draws are one sequence: ids meet on the driver, up to ``MAX_DRAWN``."""
    ids = sorted(r["id"] for r in nodes.select("id").limit(MAX_DRAWN + 1).collect())
    if len(ids) > MAX_DRAWN:
        raise ValueError("too many nodes for one random stream; order by a hash instead")
    order = np.arange(len(ids))
    rng.shuffle(order)
    return nodes.sparkSession.createDataFrame([(i, float(s)) for i, s in zip(ids, order)], "id long, score double")


def rank_ffd(nodes: DataFrame, resources: Sequence[str]) -> DataFrame:
    return nodes.select("id", _total(resources).cast("double").alias("score"))


def rank_nrm(nodes: DataFrame, links: DataFrame, resources: Sequence[str], bandwidths: Sequence[str]) -> DataFrame:
    own = nodes.select("id", _total(resources).alias("c"))
    flows = link_aggregate(nodes, links.withColumn("__b", _total(bandwidths)), "__b", "sum", n=1)
    return own.join(flows, "id").select("id", (F.col("c") * F.col("value")).cast("double").alias("score"))


def rank_nea(nodes: DataFrame, links: DataFrame, resources: Sequence[str]) -> DataFrame:
    return nodes.select("id", _total(resources).alias("c")).join(degree(nodes, links), "id").select("id", (F.col("c") * F.col("degree")).cast("double").alias("score"))


def _ends(links: DataFrame, *values: str) -> DataFrame:
    """The links with their ends in order, those of the same ends in one partition."""
    known = links.where("src is not null and dst is not null")
    return dealt(known.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *values), "src", "dst")


def _per(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    """x / total, 0 where nothing leaves a node."""
    return np.divide(x, total, out=np.zeros_like(x), where=~np.isnan(total) & (total != 0))


def rank_grc(nodes: DataFrame, links: DataFrame, resources: Sequence[str], bandwidth: str, damping: float = 0.85, tolerance: float = 1e-5, rounds: int = 100) -> DataFrame:
    """Power iteration r = (1 - d) c + d r M over the row-normalised bandwidth; c is the capacity share."""
    own = nodes.select("id", _total(resources).cast("double").alias("c"))
    total = own.agg(F.sum("c")).first()[0] or 1.0
    leaves = closure(links).groupBy(F.col("src").alias("id")).agg(F.sum(bandwidth).cast("double").alias("t"))
    share = own.select("id", (F.col("c") / total).alias("c")).join(leaves, "id", "left")
    first = share.select("id", "c", "t", F.col("c").alias("r"), F.when(F.col("t") != 0, F.col("c") / F.col("t")).alias("x"))
    tiles = Tiles(first, saved(_ends(links, bandwidth).groupBy("src", "dst").agg(F.sum(bandwidth).alias("w"))))

    def then(v, flow):
        r = (1 - damping) * v["c"] + damping * flow
        return {"c": v["c"], "t": v["t"], "r": r, "x": _per(r, v["t"])}, np.nansum((r - v["r"]) ** 2)

    state = tiles.start(["c", "t", "r", "x"])
    for k in range(rounds):
        state = tiles.step(state, "x", ["c", "t", "r", "x"], then)
        if k % 5 == 4 and (state.agg(F.sqrt(F.sum("gap"))).first()[0] or 0.0) < tolerance:
            break
    tiles.close()
    return tiles.end(state, "r").withColumnRenamed("r", "score")


def rank_rw(nodes: DataFrame, links: DataFrame, resources: Sequence[str], bandwidth: str, tolerance: float = 1e-5, rounds: int = 1000) -> DataFrame:
    """Random walk to its tolerance: restart to the share of capacity x bandwidth, else to neighbours by capacity."""
    own = nodes.select("id", _total(resources).cast("double").alias("c"))
    flows = link_aggregate(nodes, links, bandwidth, "sum", n=1)
    base = saved(own.join(flows, "id").select("id", "c", (F.col("c") * F.col("value") + 1e-9).alias("b")))
    total = base.agg(F.sum("b")).first()[0] or 1.0
    tiles = Tiles(base.select("id", "c", (F.col("b") / total).alias("b")), saved(_ends(links).distinct().withColumn("w", F.lit(1.0))))

    def begin(v, around):  # what a node's neighbours hold together
        return {"c": v["c"], "b": v["b"], "s": around, "r": v["b"], "x": _per(v["b"], around)}, 0.0

    def then(v, flow):
        r = 0.15 * v["b"] + 0.85 * v["c"] * flow
        return {"c": v["c"], "b": v["b"], "s": v["s"], "r": r, "x": _per(r, v["s"])}, np.nansum((r - v["r"]) ** 2)

    names = ["c", "b", "s", "r", "x"]
    state = tiles.step(tiles.start(["c", "b"]), "c", names, begin)
    for k in range(rounds):
        state = tiles.step(state, "x", names, then)
        if tolerance > 0 and k % 5 == 4 and (state.agg(F.sqrt(F.sum("gap"))).first()[0] or 0.0) < tolerance:
            break
    tiles.close()
    return tiles.end(state, "r").withColumnRenamed("r", "score")


def rank_nps(nodes: DataFrame, links: DataFrame, resources: Sequence[str], bandwidths: Sequence[str], weight: str | None = None) -> DataFrame:
    """Reachable nodes by least weight sum from the root, then by falling nrm, then by id; the score is the negated position.

    The root is the node with most neighbours, of several the one with the smallest id; without a weight links count 1. An
    empty network has no rows.
    """
    nrm = rank_nrm(nodes, links, resources, bandwidths).withColumnRenamed("score", "k")
    arcs = saved(arcs_of(links.withColumn("__w", F.col(weight) if weight else F.lit(1)), weight="__w"))
    near = nodes.select("id").distinct().join(arcs.groupBy(F.col("src").alias("id")).agg(F.count("dst").alias("n")), "id", "left")
    root = near.orderBy(F.coalesce("n", F.lit(0)).desc(), "id").limit(1).select("id")
    rows = least_distances(arcs, root).select("id", "distance").join(nrm, "id")
    placed = with_position(rows, [F.col("distance").asc(), F.col("k").desc(), F.col("id").asc()], "at")
    return placed.select("id", (-F.col("at")).cast("double").alias("score"))


def rank_links(links: DataFrame, how: str, bandwidths: Sequence[str] = ()) -> DataFrame:
    score = {"order": F.col("eid").cast("double"), "ffd": _total(bandwidths).cast("double")}[how]
    return links.select("eid", "src", "dst", score.alias("score"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group (Spark prunes by rank before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_max(df: DataFrame, by: Sequence[str], score: str, order: str) -> DataFrame:
    """Per group the first row, in ``order``, of the largest score; a partial aggregate."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(order))).alias("r"))
    return best.select(*by, *[F.col(f"r.{c}").alias(c) for c in rest])


def first_feasible(pairs: DataFrame, by: Sequence[str], feasible: Column, order: str, value: str) -> DataFrame:
    return pairs.where(feasible).groupBy(*by).agg(F.min_by(value, order).alias(value))


def best_offer(demands: DataFrame, offers: DataFrame, by: Sequence[str], demand: str, capacity: str, rank: Column, take: Sequence[str]) -> DataFrame:
    """Each of ``demands`` with ``take`` of the offer of its group with the greatest ``rank`` among those whose capacity holds it.

    Both tables are merged by falling size and the best offer so far is carried on, which is the staircase of the offers
    that no other beats; rows grow with both sides, not with their pairs, and a hot group is split. Demands that no offer of
    the group holds are left out, and so are null groups, sizes and ranks.
    """
    known = lambda size: reduce(lambda a, c: a & F.col(c).isNotNull(), by, F.col(size).isNotNull())
    key = F.struct(*by).alias("k")
    held = offers.where(known(capacity) & rank.isNotNull()).select(key, (-F.col(capacity).cast("double")).alias("at"), F.lit(0).alias("s"), F.struct(rank.alias("rank"), *take).alias("v"))
    asked = demands.where(known(demand)).select(key, (-F.col(demand).cast("double")).alias("at"), F.lit(1).alias("s"), F.struct(*demands.columns).alias("l"))
    out = running(held.unionByName(asked, allowMissingColumns=True), ["k"], ["at", "s"], maxes={"best": F.col("v")})
    return out.where("l is not null and best is not null").select("l.*", *[F.col("best")[c].alias(c) for c in take])


def path_score(candidates: DataFrame, nrm: str, distance: str, by: Sequence[str]) -> DataFrame:
    """nrm over the distances to all placed nodes."""
    return candidates.groupBy(*by).agg((F.first(nrm) / (F.sum(distance) + 1e-6)).alias("score"))


def nearby_score(candidates: DataFrame, degree_: str, hops: str, bandwidth: str, by: Sequence[str]) -> DataFrame:
    """degree / (1 + hops) x (2 + sum of bandwidth per hop)."""
    return candidates.groupBy(*by).agg((F.first(degree_) / (1 + F.sum(hops)) * (2 + F.sum(F.col(bandwidth) / (F.col(hops) + 1e-6)))).alias("score"))
