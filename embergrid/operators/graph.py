"""Graph analytics on link tables: iterative joins whose rounds are checkpointed, no driver graph.

``links`` has src and dst; undirected links are closed to both directions unless ``directed``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attributes import closure
from .running import running
from .storage import dealt, saved


def arcs_of(links: DataFrame, directed: bool = False, weight: str | None = None) -> DataFrame:
    """Distinct arcs, with the least weight of parallel links."""
    arcs = links if directed else closure(links)
    if weight is None:
        return dealt(arcs.select("src", "dst"), "src", "dst").distinct()
    return dealt(arcs.select("src", "dst", weight), "src", "dst").groupBy("src", "dst").agg(F.min(F.coalesce(F.col(weight), F.lit(1))).alias("w"))


def bfs(links: DataFrame, sources: DataFrame, cutoff: int | None = None, directed: bool = False) -> DataFrame:
    """(source, id, distance) of all nodes reached from each source id, nearest first.

    The frontier of all sources expands together; visited nodes leave by an anti join.
    """
    arcs = saved(arcs_of(links, directed))
    seen = frontier = saved(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance")).distinct())
    depth = 0
    while cutoff is None or depth < cutoff:
        depth += 1
        step = frontier.select("source", F.col("id").alias("src")).join(arcs, "src").select("source", F.col("dst").alias("id")).distinct()
        frontier = saved(step.join(seen, ["source", "id"], "left_anti").withColumn("distance", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if depth % 8 == 0:
            seen = saved(seen)
    return seen


def bfs_stats(distances: DataFrame) -> DataFrame:
    return distances.groupBy("source").agg(F.sum("distance").alias("total"), F.count("*").alias("reached"))


def tree_levels(distances: DataFrame) -> DataFrame:
    """(source, distance, id, place): each node's place in its level by id, counted over ranges, so a wide level is split."""
    return running(distances.select("source", "distance", "id"), ["source", "distance"], ["id"], {"n": F.lit(1)}).select("source", "distance", "id", (F.col("n") - 1).alias("place"))


def least_distances(arcs: DataFrame, sources: DataFrame, cutoff: float | None = None) -> DataFrame:
    """(source, id, distance): least weight sums over saved arcs (src, dst, w); rounds relax only the arcs of nodes that improved."""
    if not arcs.where("w < 0").isEmpty():
        raise ValueError("negative weight")
    best = changed = saved(sources.select(F.col("id").alias("source"), "id", F.lit(0).cast("double").alias("distance")).distinct())
    while True:
        step = changed.withColumnRenamed("id", "src").join(arcs, "src").groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("d"))
        if cutoff is not None:
            step = step.where(F.col("d") <= cutoff)
        changed = saved(step.join(best, ["source", "id"], "left").where("distance is null or d < distance").select("source", "id", F.col("d").alias("distance")))
        if changed.isEmpty():
            break
        best = saved(best.union(changed).groupBy("source", "id").agg(F.min("distance").alias("distance")))
    return best


def shortest_paths(links: DataFrame, sources: DataFrame, weight: str | None = None, cutoff: float | None = None, directed: bool = False) -> DataFrame:
    """(source, id, distance, via): least weight sums, and the smallest predecessor on a shortest path; negative weights are an error."""
    arcs = saved(arcs_of(links.withColumn("__w", F.col(weight) if weight else F.lit(1)), directed, "__w"))
    best = least_distances(arcs, sources, cutoff)
    tight = best.withColumnRenamed("id", "src").join(arcs, "src").select("source", F.col("dst").alias("id"), "src", (F.col("distance") + F.col("w")).alias("d"))
    via = tight.join(best, ["source", "id"]).where("d = distance and src <> id").groupBy("source", "id").agg(F.min("src").alias("via"))
    return best.join(via, ["source", "id"], "left").select("source", "id", "distance", F.when(F.col("source") != F.col("id"), F.col("via")).alias("via"))


def path_counts(links: DataFrame, distances: DataFrame, directed: bool = False) -> DataFrame:
    """(source, id, distance, paths): the number of hop-shortest paths, by levels."""
    arcs = saved(arcs_of(links, directed))
    distances = saved(distances)
    deepest = distances.agg(F.max("distance")).first()[0] or 0
    level = saved(distances.where("distance = 0").withColumn("paths", F.lit(1).cast("long")))
    out = level
    for depth in range(1, deepest + 1):
        step = level.select("source", F.col("id").alias("src"), "paths").join(arcs, "src").groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        level = saved(distances.where(F.col("distance") == depth).join(step, ["source", "id"]))
        out = out.union(level)
    return out


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each weakly connected component.

    Vertices hook to their smallest neighbour below, pointers are halved twice, and the links are
    rewritten between the labels, so they shrink from round to round.
    """
    edges = saved(dealt(links.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")), "u", "v").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        hook = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")))
        for _ in range(2):
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p").select("u", F.col("pp").alias("p"))
        hook = saved(hook)
        if labels is None:
            labels = hook.select(F.col("u").alias("id"), F.col("p").alias("component"))
        else:
            labels = labels.join(hook, F.col("component") == F.col("u"), "left").select("id", F.coalesce("p", "component").alias("component"))
        labels = saved(labels)
        at_u = edges.join(hook, "u").select("v", F.col("p").alias("a"))
        at_v = at_u.join(hook, F.col("v") == F.col("u")).select("a", F.col("p").alias("b")).where("a <> b")
        edges = saved(at_v.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    ids = nodes.select("id").distinct()
    if labels is None:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def is_connected(nodes: DataFrame, links: DataFrame) -> bool:
    """An empty graph is connected."""
    return connected_components(nodes, links).select("component").distinct().limit(2).count() <= 1


def degree_centrality(nodes: DataFrame, links: DataFrame) -> DataFrame:
    from .aggregates import degree

    n = nodes.count()
    return degree(nodes, links).select("id", (F.lit(1.0) if n <= 1 else F.col("degree") / (n - 1)).alias("score"))


def in_blocks(nodes: DataFrame, block: int) -> list[DataFrame]:
    """The nodes dealt by hash into blocks of about ``block`` each; at least one."""
    parts = max(1, -(-nodes.count() // block))
    return [nodes.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p) for p in range(parts)]


def closeness_centrality(nodes: DataFrame, links: DataFrame, directed: bool = False, block: int = 10_000) -> DataFrame:
    """(reached / total distance) (reached / (n - 1)), over distances towards the node.

    The searches run from ``block`` nodes at a time, and only their totals are kept.
    """
    n = nodes.count()
    into = links.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if directed else links
    stats = functools.reduce(DataFrame.union, [saved(bfs_stats(bfs(into, part, directed=directed))) for part in in_blocks(nodes, block)])
    r = F.col("reached") - 1
    return stats.select(F.col("source").alias("id"), F.when(F.col("total") > 0, r / F.col("total") * r / max(n - 1, 1)).otherwise(0.0).alias("score"))


def eigenvector_centrality(nodes: DataFrame, links: DataFrame, rounds: int = 100, tolerance: float = 1e-6, strict: bool = False) -> DataFrame:
    """Power iteration on A + I, in unit length; without convergence the last iterate, or an error if ``strict``."""
    n, arcs = nodes.count(), saved(arcs_of(links))
    x = saved(nodes.select("id", F.lit(1.0 / max(n, 1)).alias("x")))
    done = False
    for k in range(rounds):
        flow = arcs.join(x.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("f"))
        y = saved(x.join(flow, "id", "left").select("id", "x", (F.col("x") + F.coalesce("f", F.lit(0.0))).alias("y")))
        norm = y.agg(F.sqrt(F.sum(F.col("y") ** 2))).first()[0] or 1.0
        done = (y.agg(F.sum(F.abs(F.col("y") / norm - F.col("x")))).first()[0] or 0.0) < n * tolerance
        x = y.select("id", (F.col("y") / norm).alias("x"))
        if done:
            break
    if strict and not done:
        raise ArithmeticError("eigenvector centrality did not converge")
    return x.select("id", F.col("x").alias("score"))


def betweenness_centrality(nodes: DataFrame, links: DataFrame, directed: bool = False, block: int = 10_000) -> DataFrame:
    """Brandes by levels: path counts outwards, then dependencies from the deepest level inwards, ``block`` sources at a time."""
    n, arcs = nodes.count(), saved(arcs_of(links, directed))
    sums = functools.reduce(DataFrame.union, [saved(_dependencies(part, links, arcs, directed)) for part in in_blocks(nodes, block)])
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    total = sums.groupBy("id").agg((F.sum("s") * scale).alias("s"))
    return nodes.select("id").join(total, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("score"))


def _dependencies(sources: DataFrame, links: DataFrame, arcs: DataFrame, directed: bool) -> DataFrame:
    """(id, s): the dependencies of these sources on each node; a level's sums are written and read back by one plan at the end."""
    counts = saved(path_counts(links, bfs(links, sources, directed=directed), directed))
    deepest = counts.agg(F.max("distance")).first()[0] or 0
    level = saved(counts.where(F.col("distance") == deepest).withColumn("delta", F.lit(0.0)))
    parts = [level.where("source <> id").select("id", "delta")]
    for depth in range(deepest - 1, -1, -1):
        far = level.select("source", F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("paths")).alias("share"))
        near = counts.where(F.col("distance") == depth)
        sums = far.join(arcs, "dst").groupBy("source", F.col("src").alias("id")).agg(F.sum("share").alias("share"))
        level = saved(near.join(sums, ["source", "id"], "left").withColumn("delta", F.col("paths") * F.coalesce("share", F.lit(0.0))).drop("share"))
        parts.append(level.where("source <> id").select("id", "delta"))
        if len(parts) >= 16:  # one total in place of many levels, so that plans don't grow with the diameter
            parts = [saved(functools.reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("delta").alias("delta")))]
    return functools.reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("delta").alias("s"))


def topological_metrics(nodes: DataFrame, links: DataFrame, normalise: bool = False) -> DataFrame:
    """Degree, closeness, eigenvector and betweenness in single precision, optionally scaled to [0, 1]."""
    out = nodes.select("id")
    for name, scores in (("degree", degree_centrality(nodes, links)), ("closeness", closeness_centrality(nodes, links)), ("eigenvector", eigenvector_centrality(nodes, links, strict=True)), ("betweenness", betweenness_centrality(nodes, links))):
        out = out.join(scores.select("id", F.col("score").cast("float").alias(name)), "id")
    if normalise:
        names = out.columns[1:]
        ends = out.agg(*[f(c).alias(f"{c}_{k}") for c in names for k, f in (("lo", F.min), ("hi", F.max))])
        out = out.crossJoin(F.broadcast(ends))  # one row
        out = out.select("id", *[F.when(F.col(f"{c}_hi") == F.col(f"{c}_lo"), F.lit(0.0)).otherwise((F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo"))).cast("float").alias(c) for c in names])
    return out


def all_pairs_lengths(nodes: DataFrame, links: DataFrame, weight: str | None = None, directed: bool = False) -> DataFrame:
    """Shortest distances of all reachable pairs."""
    return shortest_paths(links, nodes, weight, directed=directed).select(F.col("source").alias("src"), F.col("id").alias("dst"), "distance")


def path_costs(paths: DataFrame, links: DataFrame, weight: str, key: str = "path_id", path: str = "path") -> DataFrame:
    """Per hop the prefix cost of every path; a missing link is an error."""
    from pyspark.sql import Window

    from .attributes import path_to_links

    arcs = arcs_of(links, weight=weight)
    hops = path_to_links(paths.select(key, path), path).join(arcs, ["src", "dst"], "left")
    cost = F.coalesce("w", F.raise_error(F.lit("missing link")).cast("double"))
    return hops.select(key, "hop", "src", "dst", F.sum(cost).over(Window.partitionBy(key).orderBy("hop").rowsBetween(Window.unboundedPreceding, 0)).alias("prefix"))
