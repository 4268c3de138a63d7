"""Near-duplicate embeddings by a PCA-ordered, tiled comparison; exact.

Equal vectors of one label are one class with a weight. The classes' second moments, added up over
all of them, give the PCA basis; it orders the dimensions by what they hold of the vectors' length and
steers cost only. Within a label the classes fall in cells of the leading coordinates whose side is the
largest distance that two linked unit vectors can have, and cells are cut into tiles of bounded size.
Only tiles of neighbouring cells meet, and only where the boxes round them are near enough. Two tiles
accumulate their dot products over the leading dimensions first; a pair whose sum plus the product
of both suffix norms stays below the threshold is given up, the others go on to further dimensions.
What is within rounding of the threshold is decided in the dimensions as given.

A tile pair returns sums of links by vector and a spanning forest of its links, never the pairs.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, those of a
null label, and those of a null vec_id link with nothing; so do vectors of different lengths. Rows that
agree in vec_id, label and vector are one and return once. A vec_id with several vectors is one vertex
with the links of all of them. An empty table has an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, discard, trimmed, written
from .components import components

THRESHOLD = 0.93
TILE_BYTES = 1 << 21
STRIP = 256
#: Coordinates of the cells, coordinates of the boxes, lengths of vectors that get a basis of their own.
CELL_DIMS, BOX_DIMS, MOST_LENGTHS = 2, 8, 16
#: Rounding of a rotated product, far above what doubles lose over a few thousand dimensions.
EPS = 1e-9
SPARSE = 1 / 8


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in unit length and double precision; scaled first, so that squares neither vanish nor overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        own = batch if len(at) == batch.num_rows else batch.take(pa.array(at))
        yield int(d), unit(matrix(own.column(column))), own


def pca_bases(vectors: DataFrame, column: str = "x") -> dict[int, np.ndarray]:
    """For each of the commonest vector lengths the directions by falling second moment, over all rows.

    A task sums up its own matrix; the driver gets d x d sums for each length.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x, _ in by_length(batch, column):
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d)), pa.array(i), pa.array(j), pa.array(m.ravel())], names=["d", "i", "j", "v"])

    common = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").limit(MOST_LENGTHS)
    lengths = [r["d"] for r in common.collect()]
    if not lengths:
        return {}
    sums = vectors.where(F.size(column).isin(lengths)).select(column).mapInArrow(trimmed(moments), "d long, i long, j long, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    full = {d: np.zeros((d, d)) for d in lengths}
    for r in sums.toLocalIterator():
        full[r["d"]][r["i"], r["j"]] = r["v"]
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() for d, m in full.items()}


def side_of(threshold: float) -> float:
    """The distance of unit vectors at the threshold."""
    return max(np.sqrt(2 - 2 * threshold), 1e-3) * (1 + 1e-6)


def cells(classes: DataFrame, bases: dict[int, np.ndarray], side: float) -> DataFrame:
    """``classes`` with d and the cell (c0, c1) of the leading coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, x, own in by_length(batch, "x"):
                z = (x @ bases[d][:, :CELL_DIMS]) if d in bases else x[:, :CELL_DIMS]
                c = np.zeros((len(x), CELL_DIMS), dtype=np.int64)
                c[:, : z.shape[1]] = np.floor(z / side)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(x), d)), *[pa.array(c[:, k]) for k in range(CELL_DIMS)]], names=[*own.schema.names, "d", *[f"c{k}" for k in range(CELL_DIMS)]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(trimmed(run), f"{kinds}, d long, " + ", ".join(f"c{k} long" for k in range(CELL_DIMS)))


CELL = ["label", "d", *[f"c{k}" for k in range(CELL_DIMS)]]


def tiles(rows: DataFrame, bases: dict[int, np.ndarray], tile_bytes: int = TILE_BYTES) -> DataFrame:
    """A row for each tile: its cell, ids, weights and vectors as bytes, and the box round its leading coordinates."""
    room = F.greatest(F.lit(64), F.floor(F.lit(tile_bytes) / (8 * F.col("d"))))
    parts = rows.groupBy(*CELL).count().select(*CELL, F.ceil(F.col("count") / room).alias("parts"))
    dealt = rows.join(parts, CELL).withColumn("sub", F.pmod(F.xxhash64("id"), "parts")).drop("parts")
    key = [*CELL, "sub"]

    def pack(table: pa.Table) -> pa.Table:
        x, head = matrix(table.column("x")), table.slice(0, 1).select(key)
        z = unit(x)
        z = z @ bases[x.shape[1]] if x.shape[1] in bases else z
        lead, rest = z[:, :BOX_DIMS], np.sqrt((z[:, BOX_DIMS:] ** 2).sum(axis=1, keepdims=True))
        box = np.concatenate([lead, rest], axis=1)
        more = {"ids": table.column("id").to_numpy().astype("<i8").tobytes(), "weights": table.column("n").to_numpy().astype("<i8").tobytes(), "vectors": x.astype("<f8" if x.dtype == np.float64 else "<f4").tobytes(), "lo": box.min(axis=0).tolist(), "hi": box.max(axis=0).tolist()}
        for name, value in more.items():
            head = head.append_column(name, pa.array([value], pa.list_(pa.float64()) if name in ("lo", "hi") else pa.binary()))
        return head

    label = rows.schema["label"].dataType.simpleString()
    schema = f"label {label}, d long, " + ", ".join(f"c{k} long" for k in range(CELL_DIMS)) + ", sub long, ids binary, weights binary, vectors binary, lo array<double>, hi array<double>"
    # dealt by the tile, not by the cell alone, whose rows may be many
    found = dealt.select(*key, "id", "n", "x").repartition(*key).groupBy(*key).applyInArrow(pack, schema)
    return found.withColumn("tile", F.concat_ws("/", *[F.col(c).cast("string") for c in key]))


def near_tiles(found: DataFrame, side: float) -> DataFrame:
    """(a, b): pairs of tiles whose boxes are near enough, a tile with itself included."""
    boxes = found.select("tile", *CELL, "lo", "hi")
    near = boxes.select(F.col("tile").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), *CELL)
    for k in range(CELL_DIMS):
        near = near.withColumn(f"c{k}", F.explode(F.array(*[F.col(f"c{k}") + s for s in (-1, 0, 1)])))
    met = near.join(boxes.withColumnRenamed("tile", "b"), CELL).where("a <= b")
    gaps = F.zip_with(F.zip_with("lo_a", "hi", lambda x, y: x - y), F.zip_with("lo", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return met.where(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= side * side).select("a", "b")


def cuts_of(d: int) -> list[int]:
    """Where partial sums are held against the bound."""
    return sorted({max(1, d // 4), max(1, d // 2), max(1, 3 * d // 4), d})


class Tile:
    """One side of a comparison: unit vectors in the basis, suffix norms at the cuts."""

    def __init__(self, row: dict, bases: dict[int, np.ndarray]):
        self.ids, self.weights = (np.frombuffer(row[c], "<i8") for c in ("ids", "weights"))
        raw = row["vectors"]
        self.given = np.frombuffer(raw, "<f8" if len(raw) == 8 * len(self.ids) * row["d"] else "<f4").reshape(len(self.ids), -1).astype(np.float64)
        own = unit(self.given)
        self.z = own @ bases[row["d"]] if row["d"] in bases else own
        squares = self.z**2
        self.rest = np.stack([np.sqrt(squares[:, c:].sum(axis=1)) for c in cuts_of(row["d"])], axis=1)


def linked(a: Tile, b: Tile, rows: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs between a strip of rows of ``a`` and all rows of ``b``."""
    za, ra, least, at = a.z[rows], a.rest[rows], threshold - EPS, 0
    sums, i, j = np.zeros((len(za), len(b.z))), None, None
    cuts = cuts_of(za.shape[1])
    for k, cut in enumerate(cuts):
        if i is None:
            sums += za[:, at:cut] @ b.z[:, at:cut].T
            alive = sums + np.outer(ra[:, k], b.rest[:, k]) >= least
            if cut == cuts[-1] or np.count_nonzero(alive) <= SPARSE * alive.size:
                i, j = np.nonzero(alive)
                p = sums[i, j]
        else:
            p = p + np.einsum("ij,ij->i", za[i, at:cut], b.z[j, at:cut])
            alive = p + ra[i, k] * b.rest[j, k] >= least
            i, j, p = i[alive], j[alive], p[alive]
        at = cut
    close = np.flatnonzero(np.abs(p - threshold) < EPS)
    if len(close):  # decided in the given dimensions
        x, y = a.given[rows][i[close]], b.given[j[close]]
        x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
        p[close] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    kept = p >= threshold
    return i[kept] + rows.start, j[kept]


def joined(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``labels`` (each at most its index, roots are their own) after the links (u, v): the least index of each component."""
    u, v = labels[u], labels[v]
    while len(u := u[keep := u != v]):
        v = v[keep]
        lo, hi = np.minimum(u, v), np.maximum(u, v)
        np.minimum.at(labels, hi, lo)
        while not np.array_equal(up := labels[labels], labels):
            labels = up
        u, v = labels[lo], labels[hi]
    return labels


def compare(a: Tile, b: Tile | None, threshold: float) -> pa.RecordBatch:
    """(u, v, n): sums of linked weights by id (v null), and a forest of the links (n null); ``b`` is None for a tile with itself."""
    other, n = b or a, len(a.ids)
    ids = a.ids if b is None else np.concatenate([a.ids, b.ids])
    weights = a.weights if b is None else np.concatenate([a.weights, b.weights])
    counts, labels = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    for at in range(0, n, STRIP):
        i, j = linked(a, other, slice(at, min(n, at + STRIP)), threshold)
        if b is None:
            own = i < j
            i, j = i[own], j[own]
        else:
            j = j + n
        np.add.at(counts, i, weights[j])
        np.add.at(counts, j, weights[i])
        labels = joined(labels, i, j)
    some, hung = np.flatnonzero(counts), np.flatnonzero(labels != np.arange(len(ids)))
    u = np.concatenate([ids[some], ids[labels[hung]]])
    v = pa.array(np.concatenate([ids[some], ids[hung]]), mask=np.arange(len(u)) < len(some))
    return pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(np.concatenate([counts[some], counts[hung]]), mask=np.arange(len(u)) >= len(some))], names=["u", "v", "n"])


def tile_links(found: DataFrame, near: DataFrame, bases: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """All tile pairs compared, each a row of its own to a task; tasks by the number of pairs, not by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield compare(Tile(row["one"], bases), None if row["a"] == row["b"] else Tile(row["two"], bases), threshold)

    tile = F.struct("d", "ids", "weights", "vectors")
    one = near.join(found.select(F.col("tile").alias("a"), tile.alias("one")), "a")
    both = one.join(found.select(F.col("tile").alias("b"), tile.alias("two")), "b")
    n = near.count()
    tasks = max(1, min(n, max(2 * found.sparkSession.sparkContext.defaultParallelism, n // 4)))
    return both.select("a", "b", "one", "two").repartition(tasks, "a", "b").mapInArrow(trimmed(run), "u long, v long, n long")


def embedding_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold over 0, up to 1")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).alias("x")).distinct()
    rows = written(rows, "vectors")
    finite = F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("x", lambda e: e != 0)
    classes = written(rows.where(sound).groupBy("label", "x").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes")
    bases, side = pca_bases(classes), side_of(threshold)
    dealt = written(cells(classes.select("label", "x", "id", "n"), bases, side), "cells")
    found = written(tiles(dealt, bases, tile_bytes), "tiles")
    near = written(near_tiles(found, side), "near")
    with arrow_batches(spark, 4):  # a row holds two tiles
        links = written(tile_links(found, near, bases, threshold), "links")
    counts = links.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("more"))
    comp = components(links.where("v is not null").select("u", "v")).select(F.col("node").alias("id"), "component")
    known = classes.join(counts, "id", "left").join(comp, "id", "left")
    known = written(known.select("label", "x", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")), "known")
    discard(dealt, found, near, links, classes)
    out = rows.join(known, ["label", "x"], "left")
    linked_to = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    n_links = F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    return out.select(F.col("id").alias("vec_id"), n_links.alias("n_links"), linked_to.alias("component_id"), (F.col("id") == linked_to).alias("kept"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
c(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.v, c.root FROM c JOIN e ON e.u = c.id WHERE c.root < e.v),
r AS (SELECT id, min(root) AS root FROM c GROUP BY id), n AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT r.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.root AS component_id, r.root = r.id AS kept FROM r LEFT JOIN n ON n.u = r.id
"""
