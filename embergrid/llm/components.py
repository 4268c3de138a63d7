"""Connected components of a link table by hooking to smaller neighbours and contraction.

Every vertex hooks to its smallest neighbour below itself, two pointer jumps shorten the chains,
and the links are rewritten between the new labels until none is left. Each round is written to
the shared folder. A label only ever falls, so a component ends at its smallest vertex. Links
are first thinned to a spanning forest within each task (same components, fewer rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, trimmed, written

LINK = "u long, v long"


def _forest(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each ``most`` vertices' links; a task's memory stays bounded."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def flush() -> pa.RecordBatch:
        found = [(v, root(v)) for v in list(parent)]
        found = [(r, v) for v, r in found if r != v]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= most:
            yield flush()
    if parent:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every vertex of ``links`` (u, v long); nulls and self-links are dropped."""
    spark = links.sparkSession
    links = links.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v")
    edges = written(links.mapInArrow(trimmed(_forest), LINK), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        first = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "hooks")
        hook = first
        for _ in range(2):
            up = first.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p").select("u", F.col("pp").alias("p"))
        hook = written(hook, "hooks")
        discard(first)
        old = labels
        if labels is None:
            labels = written(hook.select(F.col("u").alias("node"), F.col("p").alias("component")), "labels")
        else:
            labels = labels.join(hook, F.col("component") == F.col("u"), "left").select("node", F.coalesce("p", "component").alias("component"))
            labels = written(labels, "labels")
        at_u = edges.join(hook, "u").select("v", F.col("p").alias("a"))
        at_v = at_u.join(hook, F.col("v") == F.col("u")).select("a", F.col("p").alias("b")).where("a <> b")
        new = written(at_v.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
        discard(old, hook, edges)
        edges = new
    discard(edges)
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels
