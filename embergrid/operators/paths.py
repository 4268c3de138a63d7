"""Searches for many pairs of nodes at once: k shortest loopless paths, two-sided search, all tied paths.

Frontiers, candidate paths and labels are tables keyed by the pair; no graph is held by a task. ``pairs``
has source and target, links src and dst; weights are not negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import arcs_of, shortest_paths
from .storage import dropped, saved, short_lived_shuffles

PAIR = ["source", "target"]


def _arcs(links: DataFrame, weight: str | None, directed: bool, positive: bool = False) -> DataFrame:
    """Distinct arcs (src, dst, w) without loops, with the least weight of parallel ones."""
    arcs = saved(arcs_of(links.withColumn("__w", F.col(weight) if weight else F.lit(1)), directed, "__w").where("src <> dst").select("src", "dst", F.col("w").cast("double").alias("w")))
    if not arcs.where(F.col("w") <= 0 if positive else F.col("w") < 0).isEmpty():
        raise ValueError("weights must be over 0" if positive else "negative weight")
    return arcs


def _spur_paths(problems: DataFrame, arcs: DataFrame, max_hops: int | None) -> DataFrame:
    """The best path of each problem (pair, root path with its prefix costs, banned next nodes), if there is one.

    A label is the least (cost, hops, path) of its node; all problems expand together, and rounds relax only
    the arcs of labels that improved. With a bound on hops, round h holds the best paths of h hops more.
    """
    key = [*PAIR, "root"]
    label = F.struct(F.element_at("costs", -1).alias("cost"), F.size("path").alias("n"), "path", "costs")
    start = problems.select(*key, "banned", F.element_at("root", -1).alias("id"), F.col("root").alias("path"), "costs")
    best = changed = saved(start.select(*key, "banned", "id", label.alias("l")))
    while True:
        live = changed.where("id <> target") if max_hops is None else changed.where((F.col("id") != F.col("target")) & (F.col("l.n") <= max_hops))
        step = live.withColumnRenamed("id", "src").join(arcs, "src").where(~F.array_contains("l.path", F.col("dst")) & ((F.size("l.path") > F.size("root")) | ~F.array_contains("banned", F.col("dst"))))
        step = step.select(*key, "banned", F.col("dst").alias("id"), F.concat("l.path", F.array("dst")).alias("path"), F.concat("l.costs", F.array(F.element_at("l.costs", -1) + F.col("w"))).alias("costs"))
        # the banned nodes are a function of the key
        step = step.groupBy(*key, "id").agg(F.min(label).alias("m"), F.first("banned").alias("banned"))
        old = best.select(*key, "id", F.col("l").alias("old"))
        changed = saved(step.join(old, [*key, "id"], "left").where("old is null or m < old").select(*key, "banned", "id", F.col("m").alias("l")))
        if changed.isEmpty():
            break
        gone = changed.select(*key, "id")
        best = saved(best.join(gone, [*key, "id"], "left_anti").select(*changed.columns).union(changed))
    return best.where("id = target").select(*PAIR, F.size("root").alias("dev"), "l")


def k_shortest_paths(links: DataFrame, pairs: DataFrame, k: int, weight: str | None = None, max_hops: int | None = None, directed: bool = False) -> DataFrame:
    """(source, target, rank, cost, path): up to ``k`` loopless paths of every pair by cost, then hops, then node ids.

    Each round deviates from the last accepted paths of all pairs at all their nodes from the last deviation on:
    the path so far is the root, and the next nodes of accepted paths with that root are banned. Candidates
    wait in a table, from which each pair accepts its least one. A pair with equal ends has the path of that node.
    """
    arcs = _arcs(links, weight, directed)
    pairs = pairs.select(*PAIR).where("source is not null and target is not null").distinct()
    zero = F.array(F.lit(0.0))
    problems = pairs.select(*PAIR, F.array("source").alias("root"), zero.alias("costs"), F.array().cast(f"array<{pairs.schema['source'].dataType.simpleString()}>").alias("banned"))
    candidates = saved(_spur_paths(problems, arcs, max_hops))
    accepted = None
    for rank in range(1, k + 1):
        least = candidates.groupBy(*PAIR).agg(F.min("l").alias("l"))
        # a path may come from several roots; later deviations start at the shortest of them
        last = saved(least.join(candidates, [*PAIR, "l"]).groupBy(*PAIR, "l").agg(F.min("dev").alias("dev")).withColumn("rank", F.lit(rank)))
        if last.isEmpty():
            break
        accepted = last if accepted is None else accepted.union(last)
        if rank == k:
            break
        left = candidates.join(last.select(*PAIR, "l"), [*PAIR, "l"], "left_anti").select(*candidates.columns)
        at = F.explode(F.sequence(F.col("dev"), F.size("l.path") - 1))
        roots = last.where(F.size("l.path") > F.col("dev")).select(*PAIR, "l", at.alias("i")).select(*PAIR, "i", F.slice("l.path", 1, F.col("i")).alias("root"), F.slice("l.costs", 1, F.col("i")).alias("costs"))
        known = accepted.select(*PAIR, F.col("l.path").alias("p"))
        # at most k paths of the pair meet a root
        problems = roots.join(known, PAIR).where(F.slice("p", 1, F.col("i")) == F.col("root")).groupBy(*PAIR, "root", "costs").agg(F.collect_set(F.get("p", F.col("i"))).alias("banned"))
        candidates = saved(left.union(_spur_paths(problems, arcs, max_hops)))
    if accepted is None:
        return candidates.select(*PAIR, F.lit(0).alias("rank"), F.col("l.cost").alias("cost"), F.col("l.path").alias("path"))
    return accepted.select(*PAIR, "rank", F.col("l.cost").alias("cost"), F.col("l.path").alias("path"))


def two_sided_paths(links: DataFrame, pairs: DataFrame, weight: str | None = None, directed: bool = False) -> DataFrame:
    """(source, target, distance, path, settled): a shortest path of every pair that has one, by search from both ends.

    Pairs are first searched within a small reach, and those without a path of that length again within twice as much, so
    the rows of most pairs stay few; few pairs that are left, or all after a reach in which none ended, are searched without
    bound. A path found beyond the reach bounds the next search. ``settled`` counts the nodes settled in a pair's last search.
    """
    if not directed:
        links = links.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    with short_lived_shuffles(links.sparkSession):
        arcs = _arcs(links, weight, True)
        back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        ways = arcs.withColumn("side", F.lit(0)).union(back.withColumn("side", F.lit(1))) if directed else arcs.union(back)
        slack = arcs.agg(F.min("w")).first()[0] or 0.0
        light = arcs.approxQuantile("w", [0.125], 0.01)
        pairs = pairs.select(*PAIR).where("source is not null and target is not null").distinct()
        left = saved(pairs.withColumn("m", F.lit(None).cast(f"struct<d:double,path:array<{pairs.schema['source'].dataType.simpleString()}>>")))
        asked = total = left.count()
        reach = 2 * light[0] + slack if light else None
        out = None
        while out is None or asked:
            ended = saved(_within(ways, left, slack, reach, directed))
            known = F.col("m").isNotNull() if reach is None else F.coalesce(F.col("m.d") <= reach, F.lit(False))
            found = ended.where(known).select(*PAIR, F.col("m.d").alias("distance"), "m.path", "settled")
            out = found if out is None else out.union(found)
            if reach is None:
                break
            left = ended.where(~known).select(*PAIR, "m")
            before, asked = asked, left.count()
            reach = None if asked in (0, before) or asked * 16 <= total else 2 * reach
    return out


def _within(ways: DataFrame, pairs: DataFrame, slack: float, reach: float | None, directed: bool) -> DataFrame:
    """(source, target, m, settled): the best path ``m`` (d and path) of all pairs, null if there is none; ``pairs`` has one that is known, or null.

    It is a shortest one if it is within ``reach``. In a round each side of each pair settles its open nodes up to its least
    open distance plus ``slack``, the least weight of all arcs: no other path to them can be shorter. A path that is not
    found yet has an open node of either side and an arc between them, so labels that stay under the best path found, and
    within reach, with neither are dropped, and a pair ends once the least open distances and that arc come to as much, or
    one side has no open node. A row holds both sides' labels of a node, so the sides meet without a join.
    """
    top = F.col("m.d")
    if reach is not None:
        # sums in another order may exceed the reach by their rounding
        most = reach * (1 + 1e-9)
        top, ways = F.least(top, F.lit(most)), ways.where(F.col("w") < most)
    none = F.lit(None).cast(pairs.schema["m"].dataType)
    first = lambda end: F.struct(F.lit(0.0).alias("d"), F.array(end).alias("path"))
    merged = [F.min("f").alias("f"), F.min("b").alias("b"), F.max("f_at").alias("f_at"), F.max("b_at").alias("b_at")]
    start = pairs.select(*PAIR, F.col("source").alias("id"), first("source").alias("f"), none.alias("b")).union(pairs.select(*PAIR, "target", none, first("target")))
    # f_at, b_at: 0 open, 1 settled in the last round, 2 before
    labels = saved(start.withColumns({"f_at": F.lit(0), "b_at": F.lit(0)}).groupBy(*PAIR, "id").agg(*merged))
    carried, ended = pairs.select(*PAIR, F.col("m").alias("m0"), F.lit(0).cast("long").alias("before")), None
    while not labels.isEmpty():
        through = F.when(F.col("f").isNotNull() & F.col("b").isNotNull(), F.struct((F.col("f.d") + F.col("b.d")).alias("d"), F.concat("f.path", F.reverse(F.slice("b.path", 1, F.size("b.path") - 1))).alias("path")))
        fronts = [F.min(F.when(F.col(f"{s}_at") == 0, F.col(f"{s}.d"))).alias(f"{s}_least") for s in "fb"]
        state = labels.groupBy(*PAIR).agg(*fronts, F.min(through).alias("m1"), (F.count_if(F.col("f_at") == 1) + F.count_if(F.col("b_at") == 1)).alias("now"))
        over = F.col("f_least").isNull() | F.col("b_least").isNull() | F.coalesce(F.col("f_least") + F.col("b_least") + slack >= top, F.lit(False))
        state = carried.join(state, PAIR, "left").select(*PAIR, "f_least", "b_least", F.least("m0", "m1").alias("m"), (F.col("before") + F.coalesce("now", F.lit(0))).alias("settled"))
        state = saved(state.withColumn("over", over))
        done = state.where("over").select(*PAIR, "m", "settled")
        ended = done if ended is None else ended.union(done)
        going = state.where("not over")
        carried = going.select(*PAIR, F.col("m").alias("m0"), F.col("settled").alias("before"))
        live = labels.join(going.select(*PAIR, "f_least", "b_least", top.alias("top")), PAIR)
        # no better path leads on from a label that cannot stay under the best path even with the least that is left
        useful = {s: F.col(s).isNotNull() & F.coalesce(F.col(f"{s}.d") + F.col(f"{o}_least") + slack < F.col("top"), F.lit(True)) for s, o in ("fb", "bf")}
        live = live.select(*PAIR, "id", "top", *[F.when(useful[s], F.col(s)).alias(s) for s in "fb"], *[F.when(F.col(f"{s}_at") > 0, 2).when(useful[s] & (F.col(f"{s}.d") <= F.col(f"{s}_least") + slack), 1).otherwise(0).alias(f"{s}_at") for s in "fb"])
        live = saved(live.select(*[F.when(F.col(c[0]).isNotNull(), F.col(c)).otherwise(0).alias(c) if c in ("f_at", "b_at") else c for c in live.columns]).where("f is not null or b is not null"))
        dropped(labels)
        step = live.where("f_at = 1").select(*PAIR, "id", "top", F.lit(0).alias("side"), F.col("f").alias("l")).union(live.where("b_at = 1").select(*PAIR, "id", "top", F.lit(1), "b"))
        step = step.withColumnRenamed("id", "src").join(ways, ["side", "src"] if directed else "src").withColumn("d", F.col("l.d") + F.col("w"))
        # short of the other end at least one more arc follows
        more = F.when(F.col("dst") == F.when(F.col("side") == 0, F.col("target")).otherwise(F.col("source")), 0.0).otherwise(slack)
        step = step.where(F.col("top").isNull() | (F.col("d") + more < F.col("top")))
        new = F.struct("d", F.concat("l.path", F.array("dst")).alias("path"))
        step = step.select(*PAIR, F.col("dst").alias("id"), F.when(F.col("side") == 0, new).alias("f"), F.when(F.col("side") == 1, new).alias("b"), F.lit(0).alias("f_at"), F.lit(0).alias("b_at"))
        labels = saved(live.select(*step.columns).union(step).groupBy(*PAIR, "id").agg(*merged))
        dropped(live)
    return ended if ended is not None else pairs.select(*PAIR, "m", F.lit(0).cast("long").alias("settled"))


def tight_arcs(links: DataFrame, pairs: DataFrame, weight: str | None = None, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The arcs (source, target, src, dst) on shortest paths of the pairs, and the pairs' (distance, paths).

    An arc is tight for a source where its weight is what the distances of its ends differ by; the search goes
    back from the targets along tight arcs, one hop of all pairs a round, and adds up the ways from there.
    """
    _arcs(links, weight, directed, positive=True)
    pairs = saved(pairs.select(*PAIR).where("source is not null and target is not null").distinct())
    arcs = arcs_of(links.withColumn("__w", F.col(weight) if weight else F.lit(1)), directed, "__w")
    best = saved(shortest_paths(links, pairs.select(F.col("source").alias("id")).distinct(), weight, directed=directed).select("source", "id", "distance"))
    to = best.select("source", F.col("id").alias("dst"), F.col("distance").alias("d"))
    tight = saved(best.withColumnRenamed("id", "src").join(arcs, "src").join(to, ["source", "dst"]).where("distance + w = d").select("source", "src", "dst"))
    reached = pairs.join(best.withColumnRenamed("id", "target"), PAIR)
    ways = saved(reached.select(*PAIR, F.col("target").alias("id"), F.lit(1).cast("long").alias("n")))
    used = back = None
    total = ways.where("id = source")
    while True:
        back = saved(ways.where("id <> source").withColumnRenamed("id", "dst").join(tight, ["source", "dst"]).select(*PAIR, "src", "dst", "n"))
        if back.isEmpty():
            break
        used = back.select(*PAIR, "src", "dst") if used is None else saved(used.union(back.select(*PAIR, "src", "dst")).distinct())
        ways = saved(back.groupBy(*PAIR, F.col("src").alias("id")).agg(F.sum("n").alias("n")))
        total = total.union(ways.where("id = source"))
    counts = reached.join(total.groupBy(*PAIR).agg(F.sum("n").alias("paths")), PAIR).select(*PAIR, "distance", "paths")
    if used is None:
        used = tight.join(pairs, "source").where("false").select(*PAIR, "src", "dst")
    return used, counts


def tied_paths(links: DataFrame, pairs: DataFrame, weight: str | None = None, directed: bool = False, most: int | None = None) -> DataFrame:
    """(source, target, distance, path): all shortest paths of every pair; weights are over 0.

    They are counted before any of them is built; with ``most``, a pair that has more is an error.
    """
    used, counts = tight_arcs(links, pairs, weight, directed)
    counts = saved(counts)
    if most is not None and (over := counts.where(F.col("paths") > most).first()):
        raise ValueError(f"{over['paths']} shortest paths from {over['source']} to {over['target']}")
    grown = saved(counts.select(*PAIR, F.col("source").alias("id"), F.array("source").alias("path")))
    ended = grown.where("id = target")
    while not (live := grown.where("id <> target")).isEmpty():
        step = live.withColumnRenamed("id", "src").join(used, [*PAIR, "src"])
        grown = saved(step.select(*PAIR, F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")))
        ended = ended.union(grown.where("id = target"))
    return ended.join(counts, PAIR).select(*PAIR, "distance", "path")
