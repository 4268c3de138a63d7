"""Repeated products of a large link matrix with vectors over its nodes, in tiles.

Nodes stand at dense places and are cut into blocks; a tile holds the arcs from one block to another. A vector is a row
for each block, so a product sends a block to each of its tiles and their sums to the target block: a round moves
blocks, not arcs, and the tiles are bucketed once and stay where they lie.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attributes import with_position
from .storage import folder, saved

LEAST, MOST = 1 << 10, 1 << 17
PART_ARCS = 1 << 21
_KIND = {"s": np.int32, "d": np.int32, "w": np.float64}


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs sorted by tile as rows of many, none of which holds arcs of two tiles."""
    for batch in batches:
        cells = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("i", "j", "s", "d", "w")}
        new = np.flatnonzero((np.diff(cells["i"]) != 0) | (np.diff(cells["j"]) != 0)) + 1
        first = np.concatenate([[0], new]).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
        last = np.append(first[1:], batch.num_rows)
        rows = {n: [np.ascontiguousarray(cells[n][a:b], t).tobytes() for a, b in zip(first, last)] for n, t in _KIND.items()}
        yield pa.RecordBatch.from_pydict({"i": pa.array(cells["i"][first], pa.int32()), "j": pa.array(cells["j"][first], pa.int32())} | {n: pa.array(v, pa.binary()) for n, v in rows.items()})


class Tiles:
    """The symmetric matrix of ``links`` (src, dst, w), each pair of ends once, among ``nodes`` (id and values); other ends are left out.

    ``start`` gives vectors, ``step`` a product and what follows from it, ``end`` the rows again. Values that are null or NaN
    add nothing to products. ``close`` when the last vectors are written.
    """

    def __init__(self, nodes: DataFrame, links: DataFrame):
        spark = nodes.sparkSession
        self.place = saved(with_position(nodes, [F.col("id")], "at"))
        n, arcs = self.place.count(), 2 * links.count()
        # so many blocks that their copies are few beside the arcs
        self.size = int(min(max(2 * n * n // max(arcs, 1), LEAST), MOST))
        at = lambda end: self.place.select(F.col("id").alias(end), F.col("at").alias(f"at_{end}"))
        placed = links.join(at("src"), "src").join(at("dst"), "dst").select(F.col("at_src").alias("a"), F.col("at_dst").alias("b"), F.col("w").cast("double").alias("w"))
        there, back = F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
        ends = F.explode(F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, back)))
        cut = lambda c, f: F.expr(f"int(x.{c} {f} {self.size})")
        cells = placed.select(ends.alias("x"), "w").select(cut("u", "div").alias("i"), cut("v", "div").alias("j"), cut("u", "%").alias("s"), cut("v", "%").alias("d"), "w")
        parts = max(-(-arcs // PART_ARCS), spark.sparkContext.defaultParallelism)
        # one number to sort by: rows of a tile need no order among themselves
        rows = cells.repartition(parts, "i", "j").sortWithinPartitions(F.expr("shiftleft(bigint(i), 32) + j")).mapInArrow(_packed, "i int, j int, s binary, d binary, w binary")
        self.name = f"embergrid_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(parts, "i", "j").option("path", folder(spark, "tiles")).saveAsTable(self.name)
        self.tiles = spark.table(self.name)
        self.pairs = saved(self.tiles.select("i", "j").distinct())

    def start(self, names: Sequence[str]) -> DataFrame:
        """A row for each block: its number and the columns ``names`` of the nodes in order of place."""
        size = self.size

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by("at")
            own = {n: pa.array([table[n].to_numpy().astype(np.float64).tobytes()], pa.binary()) for n in names}
            return pa.table({"block": table["block"][:1].combine_chunks()} | own)

        rows = self.place.select(F.expr(f"int(at div {size})").alias("block"), "at", *[F.col(n).cast("double").alias(n) for n in names])
        return saved(rows.groupBy("block").applyInArrow(pack, "block int, " + ", ".join(f"{n} binary" for n in names)))

    def step(self, vectors: DataFrame, x: str, names: Sequence[str], then: Callable[[dict, np.ndarray], tuple[dict, float]]) -> DataFrame:
        """The vectors ``names`` that ``then`` makes of the old ones and of the product of the matrix and ``x``, block by block, and a number ``gap`` for each block."""
        size, own = self.size, [c for c in vectors.columns if c not in ("block", "gap")]

        def multiply(tile: pa.Table, block: pa.Table) -> pa.Table:
            values = np.frombuffer(block["x"][0].as_py())
            s, d, w = (np.concatenate([np.frombuffer(v.as_buffer(), t) for v in tile[n]]) for n, t in _KIND.items())
            out = np.bincount(d, np.where(np.isnan(values), 0.0, values)[s] * w, minlength=size)
            return pa.table({"j": tile["j"][:1].combine_chunks(), "f": pa.array([out.tobytes()], pa.binary())})

        def follow(block: pa.Table, sums: pa.Table) -> pa.Table:
            have = {n: np.frombuffer(block[n][0].as_py()) for n in own}
            total = np.zeros(size)
            for f in sums["f"]:
                total += np.frombuffer(f.as_buffer())
            made, gap = then(have, total[: len(have[own[0]])])
            return pa.table({"block": block["block"].combine_chunks()} | {n: pa.array([made[n].tobytes()], pa.binary()) for n in names} | {"gap": pa.array([float(gap)])})

        sent = vectors.select(F.col("block").alias("i"), F.col(x).alias("x")).join(F.broadcast(self.pairs), "i")
        sums = self.tiles.groupBy("i", "j").cogroup(sent.groupBy("i", "j")).applyInArrow(multiply, "j int, f binary")
        return saved(vectors.groupBy("block").cogroup(sums.groupBy("j")).applyInArrow(follow, "block int, " + ", ".join(f"{n} binary" for n in names) + ", gap double"))

    def end(self, vectors: DataFrame, name: str) -> DataFrame:
        """(id, ``name``) of all nodes; NaN is null."""
        size = self.size

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, v in zip(batch.column("block").to_pylist(), batch.column("v")):
                    values = np.frombuffer(v.as_buffer())
                    yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(values), dtype=np.int64) + b * size), name: pa.array(values, from_pandas=True)})

        found = vectors.select("block", F.col(name).alias("v")).mapInArrow(rows, f"at long, {name} double")
        return self.place.select("id", "at").join(found, "at").select("id", name)

    def close(self) -> None:
        """Forget the table of tiles; its files stay in the shared folder, with those of all written tables."""
        self.place.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
