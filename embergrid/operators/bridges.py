"""Bridges of large graphs: cycles are drawn together first; what is left gets a spanning forest, its Euler tour ranked by
pointer jumping, subtree extrema.

All steps are joins and aggregates whose number of rounds grows with the logarithm of the graph, whatever
its depth; no vertex's links meet in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attributes import closure, with_position
from .storage import ranged, saved


def _simple(links: DataFrame) -> DataFrame:
    """Each pair of different ends once, the smaller one as src; the links of a dst lie side by side, a long row of them in several files."""
    plain = links.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return saved(ranged(plain, "dst", "src").distinct().sortWithinPartitions("dst", "src"))


def _roots(hook: DataFrame) -> DataFrame:
    """(hi, root) of trees given as (hi, lo), lo being the node above hi: pointers jump for nodes that have others below, the rest looks up once."""
    above = saved(hook.select(F.col("lo").alias("hi")).distinct())
    inner = saved(hook.join(above, "hi", "left_semi"))
    if inner.isEmpty():
        return hook.select("hi", F.col("lo").alias("root"))
    while True:
        for _ in range(2):  # two jumps for each table that is written
            up = inner.select(F.col("hi").alias("lo"), F.col("lo").alias("up"))
            inner = inner.join(up, "lo", "left").select("hi", F.coalesce("up", "lo").alias("lo"), F.col("up").isNotNull().alias("moved"))
        inner = saved(inner)
        if inner.where("moved").isEmpty():
            break
    up = inner.select(F.col("hi").alias("lo"), F.col("lo").alias("root"))
    return saved(hook.join(up, "lo", "left").select("hi", F.coalesce("root", "lo").alias("root")))


def _split(edges: DataFrame, rows: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``edges`` (src < dst, and more) that make up a spanning forest, all others, and (id, component) with the smallest id of each tree.

    In a round every label hooks to its smallest neighbour below it; pointers jump until they stand at roots, and the
    edges are rewritten between those. Every edge's greater end hooks, and only smaller ends that hook need a look-up.
    Repeated edges stay apart: one of them at most is in the forest. Without ``rows`` only the labels are found.
    """
    own = edges.columns if rows else []
    left = edges.select(F.col("src").alias("lo"), F.col("dst").alias("hi"), *own)
    forest, others, labels, moved = edges.where("false"), edges.where("false"), edges.where("false").select(F.col("src").alias("id"), F.col("dst").alias("component")), None
    first = True
    while not left.isEmpty():
        if not rows or first and len(own) == 2:  # a single edge for each pair of ends
            picks = saved(left.groupBy("hi").agg(F.min("lo").alias("lo")))
            links = picks.select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
            same = F.col("lo") == F.col("pick.lo")
        else:
            picks = saved(left.groupBy("hi").agg(F.min(F.struct("lo", *own)).alias("m")).select("hi", "m.*"))
            links = picks.select(*own)
            same = F.struct("lo", *own) == F.col("pick")
        roots = _roots(picks.select("hi", "lo"))
        ends = saved(left.select(F.col("lo").alias("hi")).distinct())
        asked = saved(roots.join(ends, "hi", "left_semi"))
        known = roots.union(ends.join(asked, "hi", "left_anti").select("hi", F.col("hi").alias("root"))).toDF("id", "component")
        if first:
            labels = known
        elif moved is None:
            moved = saved(known)
        else:
            moved = saved(moved.join(roots.toDF("component", "root"), "component", "left").select("id", F.coalesce("root", "component").alias("component")))
        at_hi = roots
        if rows:
            forest = forest.union(links)
            pick = picks.select("hi", F.struct("lo", *[c for c in own if c in picks.columns]).alias("pick"))
            at_hi = roots.join(pick, "hi")
        met = left.join(at_hi, "hi")
        if rows:
            met = met.where(~same)
        met = met.select("lo", F.col("root").alias("at"), *own).join(asked.toDF("lo", "root"), "lo", "left").select(F.coalesce("root", "lo").alias("x"), "at", *own)
        met = met.select(F.least("x", "at").alias("lo"), F.greatest("x", "at").alias("hi"), *own)
        met = saved(met if rows else met.where("lo < hi"))
        if rows:
            others = others.union(met.where("lo = hi").select(*own))
        left, first = met.where("lo < hi"), False
    if moved is not None:
        labels = labels.join(moved.toDF("component", "last"), "component", "left").select("id", F.coalesce("last", "component").alias("component"))
    return forest, others, labels


def spanning_forest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst) of a spanning forest's links, and (id, component) with the smallest id of each tree.

    Loops and repeated links count for nothing.
    """
    forest, _, labels = _split(_simple(links))
    return forest, labels


def euler_tour(forest: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, pos): both arcs of every tree link at their places in the tours, one tree after the other.

    The arc after (u, v) leaves v for the neighbour that follows u, the last one's follower being the first; a tree's
    tour begins with the first arc of its root. Places are ranks in the resulting lists, by pointer jumping.
    """
    arcs = with_position(closure(forest.select("src", "dst")), [F.col("src"), F.col("dst")], "at")
    ends = saved(arcs.groupBy("src").agg(F.min("at").alias("first"), F.max("at").alias("last")))
    starts = ends.join(labels.where("id = component").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("first").alias("next"), F.lit(True).alias("start"))
    twin = arcs.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("at").alias("twin"))
    follow = arcs.join(twin, ["src", "dst"]).join(ends.withColumnRenamed("src", "dst"), "dst")
    follow = follow.select("at", F.when(F.col("twin") < F.col("last"), F.col("twin") + 1).otherwise(F.col("first")).alias("next"))
    follow = follow.join(starts, "next", "left").select("at", F.when(F.col("start").isNull(), F.col("next")).alias("next"))
    ranks = saved(follow.select("at", "next", F.col("next").isNotNull().cast("long").alias("left")))
    while not ranks.where("next is not null").isEmpty():
        for _ in range(2):
            to = ranks.select(F.col("at").alias("next"), F.col("next").alias("after"), F.col("left").alias("more"))
            ranks = ranks.join(to, "next", "left").select("at", F.col("after").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
        ranks = saved(ranks)
    placed = arcs.join(ranks.select("at", "left"), "at").join(labels.withColumnRenamed("id", "src"), "src")
    return with_position(placed, [F.col("component"), F.desc("left")], "pos").select("src", "dst", "pos")


def _extrema(values: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (id, enter, leave) with the least lo and the greatest hi of ``values`` (pos, lo, hi) from enter to leave.

    Level k holds the extrema of 2^k places from each place on; a span is covered by two runs of its level.
    """
    length = F.col("leave") - F.col("enter") + 1
    # exact for lengths below 2^53
    spans = saved(spans.withColumn("k", F.length(F.bin(length)) - 1))
    levels = spans.agg(F.max("k")).first()[0]
    out, level = None, values
    for k in range((levels or 0) + 1):
        own = spans.where(F.col("k") == k)
        ends = level.select(F.col("pos").alias("q"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        found = own.join(level, F.col("pos") == F.col("enter")).join(ends, F.col("q") == F.col("leave") - (1 << k) + 1)
        found = found.select("id", "enter", "leave", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"))
        out = found if out is None else out.union(found)
        if k < (levels or 0):
            # runs that end with the table are shorter, and no span asks for them
            right = level.select((F.col("pos") - (1 << k)).alias("pos"), "lo", "hi").where("pos >= 0")
            level = saved(level.union(right).groupBy("pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    return out


def _contracted(forest: DataFrame, labels: DataFrame) -> DataFrame:
    """The forest's links between the labels of their ends (src < dst), with their own ends as s and d; those within a label are left out."""
    s, d = ("s", "d") if "s" in forest.columns else ("src", "dst")
    edges = forest.select("src", "dst", F.col(s).alias("s"), F.col(d).alias("d"))
    for end in ("src", "dst"):
        ends = saved(edges.select(F.col(end).alias("id")).distinct())
        at = saved(labels.join(ends, "id", "left_semi").toDF(end, "at"))
        edges = edges.join(at, end, "left").withColumn(end, F.coalesce("at", end)).drop("at")
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "s", "d")


def _by_tour(links: DataFrame) -> DataFrame:
    """(src, dst) of the bridges: a tree link is one where no other link leaves the subtree below it: the extreme places
    that the subtree's other links lead to stay in its own run of the tour."""
    plain = _simple(links)
    forest, others, labels = _split(plain)
    labels = saved(labels)
    tour = saved(euler_tour(forest, labels))
    back = tour.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("pos").alias("leave"))
    # the arc that comes first leads down to dst
    spans = saved(tour.join(back, ["src", "dst"]).where("pos < leave").select(F.col("dst").alias("id"), F.col("src").alias("parent"), F.col("pos").alias("enter"), "leave"))
    # a root's place is before all of its subtrees
    place = labels.join(spans.select("id", "enter"), "id", "left").select("id", F.coalesce("enter", F.lit(-1)).alias("place"))
    leads = closure(others).withColumnRenamed("dst", "id").join(place, "id").groupBy(F.col("src").alias("id")).agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    own = spans.join(leads, "id", "left").select(F.col("enter").alias("pos"), F.least("enter", "lo").alias("lo"), F.greatest("enter", "hi").alias("hi"))
    values = saved(own.union(spans.select("leave", "leave", "leave")))
    found = _extrema(values, spans.select("id", "enter", "leave")).where("lo >= enter and hi <= leave")
    return found.select("id").join(spans.select("id", "parent"), "id").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))


def bridges(links: DataFrame) -> DataFrame:
    """(src, dst), src < dst, of the links without which their component falls apart; directions play no part.

    A link outside of a spanning forest lies on a cycle, and drawing together the ends of links that are no bridges changes
    nothing about the others. So the components of all links outside of the forest become nodes, between which only forest
    links are left, and a link that alone leads to a node is a bridge. This is repeated while it halves the links; the
    tour decides the rest. Loops and repeated links count for nothing.
    """
    edges = _simple(links)
    found, left = edges.where("false"), edges.count()
    while left:
        forest, others, _ = _split(edges)
        if others.isEmpty():
            return found.union(forest.select(*forest.columns[-2:]))
        edges = saved(_contracted(forest, _split(others.select("src", "dst"), rows=False)[2]))
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
        tips = saved(ends.groupBy("id").count().where("count = 1").select("id", F.lit(True).alias("tip")))
        for end in ("src", "dst"):
            edges = edges.join(tips.toDF(end, f"{end}_tip"), end, "left")
        edges = saved(edges.select("src", "dst", "s", "d", F.coalesce("src_tip", "dst_tip").alias("tip")))
        found = found.union(edges.where("tip").select("s", "d"))
        edges = edges.where("tip is null").drop("tip")
        before, left = left, edges.count()
        if 2 * left > before:
            pairs = saved(edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("s").alias("s"), F.min("d").alias("d")))
            return found.union(_by_tour(pairs).join(pairs.where("n = 1"), ["src", "dst"]).select("s", "d"))
    return found
