"""Operator 7: conflict-constrained best-fit packing of documents into training sequences.

A bin holds up to ``capacity`` tokens and never two documents of one source or of one cluster of
equal texts. Open bins are ordered by residual and carry bitmaps of their sources and clusters;
a document goes to the tightest bin that has room and no common bit, found by searching on from
the first residual that fits; without any it opens a bin.

Documents are dealt by a hash into shards of about ``shard_docs``; a shard is read in order of
falling length and packed in runs of at most ``2 * shard_docs``, so a task's memory is bounded
whatever the keys are, and the hot source or cluster spreads over all shards. Only slim columns
are shuffled. A document longer than a bin fills whole bins of its own and its rest is packed.

``pack`` takes any lengths and clusters. ``pack_documents`` counts words; without a ``clusters``
table (doc_id, cluster), such as the components of the Jaccard join, equal texts are one cluster.
``pack_tokens`` counts the ids of the token files' encoder and returns them with their places;
``sequences`` joins the ids of a bin to one training sequence with its document bounds.

Defined results: a text's length is its words (ids) and one end token, null or empty texts have
length 1; a null source is no source and conflicts with none; a null cluster is none (null texts
without a ``clusters`` table, documents that are not in one or have no id). Every row is placed;
repeated rows are packed as often as they occur. The result of ``pack`` does not depend on the
partitions of the input. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches, trimmed, written
from .token_files import END_ID, default_tokenizer, encoder

CAPACITY = 2048
SHARD_DOCS = 1024
PACKED = "doc_id long, piece int, bin_id long, start int, n_tokens int"


def text_length(text: Column) -> Column:
    """Words and one end token."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


class BestFit:
    """Bins by residual; ``place`` gives (bin, start) of an item."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.by_residual: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
        self.filled = 0  # a bit for each residual that has bins

    def place(self, size: int, sources: int, clusters: int) -> tuple[int, int]:
        later = self.filled >> size << size
        while later:
            residual = (later & -later).bit_length() - 1
            own = self.by_residual[residual]
            for k, (number, held_sources, held_clusters) in enumerate(own):
                if not (held_sources & sources or held_clusters & clusters):
                    del own[k]
                    if not own:
                        self.filled &= ~(1 << residual)
                    self._put(number, residual - size, held_sources | sources, held_clusters | clusters)
                    return number, self.capacity - residual
            later &= later - 1
        number, self.bins = self.bins, self.bins + 1
        self._put(number, self.capacity - size, sources, clusters)
        return number, 0

    def _put(self, number: int, residual: int, sources: int, clusters: int) -> None:
        own, at = self.by_residual[residual], 0
        while at < len(own) and own[at][0] < number:
            at += 1
        own.insert(at, [number, sources, clusters])
        self.filled |= 1 << residual


def pack_items(items: list[tuple[int, int, object, object]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(doc_id, piece, bin, start, n_tokens) for items (doc_id, length, source, cluster), in order."""
    fit, bits, out = BestFit(capacity), {}, []
    for doc_id, length, source, cluster in items:
        source_bit = 0 if source is None else 1 << bits.setdefault(("source", source), len(bits))
        cluster_bit = 0 if cluster is None else 1 << bits.setdefault(("cluster", cluster), len(bits))
        piece = 0
        while length > capacity:
            out.append((doc_id, piece, fit.bins, 0, capacity))
            fit.bins += 1
            piece, length = piece + 1, length - capacity
        number, start = fit.place(length, source_bit, cluster_bit)
        out.append((doc_id, piece, number, start, length))
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pack rows (doc_id long, length long, source string, cluster string)."""
    items = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("length").cast("long").alias("length"), "source", "cluster")
    shards = max(1, -(-items.count() // shard_docs))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "source", "cluster"), F.lit(shards)).cast("long"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "source", "cluster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, first = None, [], 0

        def flush() -> tuple[pa.RecordBatch, int]:
            doc_id, piece, bins, start, size = zip(*pack_items(own, capacity))
            own.clear()
            numbers = [pa.array(piece, pa.int32()), pa.array(np.array(bins) + (shard << 32) + first), pa.array(start, pa.int32()), pa.array(size, pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), *numbers], names=["doc_id", "piece", "bin_id", "start", "n_tokens"]), max(bins) + 1

        for batch in batches:
            for doc_id, length, source, cluster, s in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if own and (s != shard or len(own) >= 2 * shard_docs):
                    packed, used = flush()
                    yield packed
                    first += used
                if s != shard:
                    shard, first = s, 0
                own.append((doc_id, length, source, cluster))
        if own:
            yield flush()[0]

    return dealt.mapInArrow(trimmed(run), PACKED)


def _clustered(docs: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """``docs`` with a string column ``cluster``."""
    if clusters is None:
        return docs.withColumn("cluster", F.sha2("text", 256))
    found = clusters.groupBy(F.col("doc_id").alias("d")).agg(F.min(F.col("cluster").cast("string")).alias("cluster"))
    return docs.join(found, F.col("doc_id") == F.col("d"), "left").drop("d")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, clusters: DataFrame | None = None) -> DataFrame:
    """Pack documents (doc_id, text, source) by the words of their texts."""
    items = _clustered(docs.select("doc_id", "text", F.col("source").cast("string").alias("source")), clusters)
    return pack(items.select("doc_id", text_length(F.col("text")).alias("length"), "source", "cluster"), capacity, shard_docs)


def tokenised(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(row, doc_id, source, cluster, ids) of (doc_id, text, source, cluster), written; ``row`` numbers the rows."""
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        enc.forget()
        for batch in batches:
            ids, sizes = enc.encode(batch.column(3))
            ids = np.insert(ids, np.cumsum(sizes), end_id).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "source", "cluster", "ids"])
        enc.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "cluster", "text").mapInArrow(trimmed(run), "doc_id long, source string, cluster string, ids array<int>")
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "tokenised")


def pack_tokens(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, clusters: DataFrame | None = None, tokenizer: str | None = None) -> DataFrame:
    """Pack documents (doc_id, text, source) by their token ids: (doc_id, piece, bin_id, start, n_tokens, ids)."""
    texts = _clustered(docs.select("doc_id", "text", F.col("source").cast("string").alias("source")), clusters)
    rows = tokenised(texts, tokenizer)
    places = pack(rows.select(F.col("row").alias("doc_id"), F.size("ids").cast("long").alias("length"), "source", "cluster"), capacity, shard_docs)
    placed = places.withColumnRenamed("doc_id", "row").join(rows.select("row", "doc_id", "ids"), "row")
    return placed.select("doc_id", "piece", "bin_id", "start", "n_tokens", F.slice("ids", F.col("piece") * capacity + 1, F.col("n_tokens")).alias("ids"))


def sequences(placed: DataFrame) -> DataFrame:
    """A row for each bin of ``pack_tokens``: its ids, and in order the documents, pieces and starts in it."""
    parts = F.array_sort(F.collect_list(F.struct("start", "doc_id", "piece", "ids"))).alias("p")
    bins = placed.groupBy("bin_id").agg(parts)
    return bins.select("bin_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.piece").alias("pieces"), F.col("p.start").alias("starts"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
