"""Ranked lexical search: Block-Max WAND over shards of documents.

Texts are indexed where they are read: a task cuts its documents into shards of bounded size, and a
shard is one row of the index. In a shard, documents are numbered by length, so that a block's
documents have like impacts, and each term's postings form blocks of 128, compressed as gaps and
frequencies of one, two or four bytes. A block keeps its first and last document and its largest impact.

A query's shallow pointer moves run over those bounds alone: between two neighbouring block bounds no
list changes its block, so the sum of the current blocks' largest impacts bounds every document there.
Stretches whose bound is under the threshold, the k-th best score so far, are skipped, and a block that
lies only in such stretches is never decompressed. Stretches with the largest bounds go first, which
raises the threshold early; it is carried on from shard to shard within a task.

Defined results: a null text has no terms; documents without terms count for nothing; a document with a
null doc_id counts in all statistics and is never returned; rows that repeat a doc_id are documents of
their own, ranked next to each other; ids are cast to long. Rows that agree in item_id and text are one item, an
item_id with several texts has the terms of all of them, an item without terms has no rows, and a null
item_id is an id like others. Empty tables give no rows; other columns play no part. Terms are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, discard, documents, trimmed, written
from .wordhash import batch_words

TOP = 10
BLOCK = 128
SHARD_BYTES = 16 << 20
#: Query terms that are shipped to the tasks at once; more items go in further passes over the index.
QUERY_TERMS = 1 << 20
#: Stretches that are scored before the threshold is looked at again, at first.
FIRST_STRETCHES = 64
NO_ID = -(1 << 63)

#: Bytes of terms: ASCII letters and digits, and all of other characters.
IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

ARRAYS = {"ids": "<i8", "m": "<i8", "terms": "<u8", "counts": "<i4", "first": "<i4", "last": "<i4", "top": "<i4", "kind": "u1", "data": "u1"}
SHARD = ", ".join(f"{name} binary" for name in ARRAYS)


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with terms, terms with repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for _, words, at in batch_words(batch.column(0), IS_TERM):
                total += (np.count_nonzero(np.diff(at)), len(words))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.tolist()], names=["n", "l"])

    found = docs.select(text).mapInArrow(trimmed(run), "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return found[0] or 0, found[1] or 0


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (10**9 * tf) // (1000 * tf + 8 * m)


def widths(values: np.ndarray) -> np.ndarray:
    return np.where(values < 1 << 8, 1, np.where(values < 1 << 16, 2, 4))


def put(data: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """Little-endian ``values`` of ``width`` bytes at the places ``at``."""
    for j in range(4):
        some = width > j
        data[at[some] + j] = (values[some] >> (8 * j)) & 255


def get(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.int64)
    for j in range(4):
        some = width > j
        out[some] |= data[at[some] + j].astype(np.int64) << (8 * j)
    return out


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def pack_shard(ids: np.ndarray, doc: np.ndarray, words: np.ndarray, n_docs: int, total: int) -> dict[str, np.ndarray]:
    """The index of one shard from its documents' ids and its tokens (document, term)."""
    n = np.bincount(doc, minlength=len(ids))
    order = np.argsort(n, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    n = n[order]
    m = 25 + (75 * n * n_docs) // max(total, 1)
    terms, which = np.unique(words, return_inverse=True)
    pairs = np.sort(which * len(ids) + place[doc])
    starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    tf = np.diff(np.append(starts, len(pairs)))
    t, d = np.divmod(pairs[starts], len(ids))
    counts = np.bincount(t, minlength=len(terms))
    inside = np.arange(len(t)) - np.repeat(np.cumsum(counts) - counts, counts)
    begins = np.flatnonzero(inside % BLOCK == 0)
    sizes = np.diff(np.append(begins, len(t)))
    block = np.repeat(np.arange(len(begins)), sizes)
    gaps = np.diff(d, prepend=0)
    gaps[begins] = 0
    reduced = (lambda f, x: f.reduceat(x, begins)) if len(begins) else (lambda f, x: x)
    gap_width, tf_width = widths(reduced(np.maximum, gaps)), widths(reduced(np.maximum, tf))
    ends = np.cumsum(sizes * (gap_width + tf_width))
    at = ends - sizes * (gap_width + tf_width)
    data, k = np.zeros(ends[-1] if len(ends) else 0, dtype=np.uint8), inside % BLOCK
    put(data, at[block] + k * gap_width[block], gaps, gap_width[block])
    put(data, at[block] + sizes[block] * gap_width[block] + k * tf_width[block], tf, tf_width[block])
    return {"ids": ids[order], "m": m, "terms": terms, "counts": counts, "first": d[begins], "last": d[begins + sizes - 1], "top": reduced(np.maximum, impacts(tf, m[d])), "kind": gap_width * 16 + tf_width, "data": data}


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, int]:
    """The index of all terms of all rows, a written table with a row for each shard, and the corpus size; nothing is shuffled."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    with arrow_batches(docs.sparkSession, 500):
        n_docs, total = corpus_size(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, doc, words, held, size = [], [], [], 0, 0

            def flush() -> pa.RecordBatch:
                packed = pack_shard(np.concatenate(ids), np.concatenate([np.zeros(0, np.int64), *doc]), np.concatenate([np.zeros(0, np.uint64), *words]), n_docs, total)
                return pa.RecordBatch.from_arrays([pa.array([packed[c].astype(kind).tobytes()], pa.binary()) for c, kind in ARRAYS.items()], names=list(ARRAYS))

            for batch in batches:
                for at in range(0, batch.num_rows, 100):  # a shard grows by a hundred texts at most before it is looked at
                    own = batch.slice(at, 100)
                    ids.append(own.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
                    for first, found, bounds in batch_words(own.column(1), IS_TERM):
                        words.append(found)
                        doc.append(np.repeat(held + first + np.arange(len(bounds) - 1), np.diff(bounds)))
                        size += 8 * len(found)
                    held += own.num_rows
                    if size >= shard_bytes:
                        yield flush()
                        ids, doc, words, held, size = [], [], [], 0, 0
            if held:
                yield flush()

        return written(rows.mapInArrow(trimmed(run), SHARD), "index"), n_docs, total


class Shard:
    """A shard of the index, seen by the terms that some query has; blocks are decompressed when they are first scored."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        a = {c: np.frombuffer(row[c], kind) for c, kind in ARRAYS.items()}
        self.ids, self.m, self.data = a["ids"], a["m"], a["data"]
        per_term = -(-a["counts"].astype(np.int64) // BLOCK)
        last_of_term = np.cumsum(per_term) - 1
        sizes = np.full(len(a["first"]), BLOCK, dtype=np.int64)
        sizes[last_of_term] = a["counts"] - (per_term - 1) * BLOCK
        gap_width, tf_width = (a["kind"] >> 4).astype(np.int64), (a["kind"] & 15).astype(np.int64)
        at = np.cumsum(sizes * (gap_width + tf_width)) - sizes * (gap_width + tf_width)
        place = np.searchsorted(a["terms"], vocabulary)
        place[place == len(a["terms"])] = 0
        here = a["terms"][place] == vocabulary if len(a["terms"]) else np.zeros(len(vocabulary), dtype=bool)
        place = place[here]
        own = spans(last_of_term[place] + 1 - per_term[place], per_term[place])
        # blocks of the vocabulary's terms, and each term's range of them
        self.term_blocks = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        self.term_blocks[1:][here] = per_term[place]
        self.term_blocks = np.cumsum(self.term_blocks)
        self.first, self.last, self.top = (a[c][own].astype(np.int64) for c in ("first", "last", "top"))
        self.sizes, self.at, self.gap_width, self.tf_width = sizes[own], at[own], gap_width[own], tf_width[own]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.open = np.zeros(len(own), dtype=bool)
        self.docs, self.impacts = np.zeros((2, int(self.sizes.sum())), dtype=np.int64)

    def postings(self, blocks: np.ndarray) -> np.ndarray:
        """Positions of the postings of ``blocks`` in ``docs`` and ``impacts``."""
        new = blocks[~self.open[blocks]]
        if len(new):
            sizes = self.sizes[new]
            block, k = np.repeat(new, sizes), spans(np.zeros(len(new), dtype=np.int64), sizes)
            gaps = np.cumsum(get(self.data, self.at[block] + k * self.gap_width[block], self.gap_width[block]))
            begins = np.cumsum(sizes) - sizes
            docs = gaps - np.repeat(gaps[begins], sizes) + self.first[block]
            tf = get(self.data, self.at[block] + self.sizes[block] * self.gap_width[block] + k * self.tf_width[block], self.tf_width[block])
            to = self.begins[block] + k
            self.docs[to], self.impacts[to] = docs, impacts(tf, self.m[docs])
            self.open[new] = True
        return spans(self.begins[blocks], self.sizes[blocks])

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores, doc ids), brought up to date with this shard's documents."""
        counts = self.term_blocks[terms + 1] - self.term_blocks[terms]
        blocks = spans(self.term_blocks[terms], counts)
        if not len(blocks):
            return best
        weight = np.repeat(weights, counts)
        first, after, top = self.first[blocks], self.last[blocks] + 1, self.top[blocks] * weight
        # shallow moves: between two bounds the lists' current blocks stay the same
        edges = np.unique(np.concatenate([first, after]))
        lo, hi = np.searchsorted(edges, first), np.searchsorted(edges, after)
        bound = np.zeros(len(edges), dtype=np.int64)
        np.add.at(bound, lo, top)
        np.subtract.at(bound, hi, top)
        bound = np.cumsum(bound)[:-1]
        order, at, step = np.argsort(-bound, kind="stable"), 0, FIRST_STRETCHES
        while at < len(order):
            least = best[0][k - 1] if len(best[0]) >= k else 1
            chosen = order[at : at + step]
            chosen = chosen[bound[chosen] >= least]
            if not len(chosen):
                break
            at, step = at + step, step * 4
            live = np.zeros(len(bound), dtype=bool)
            live[chosen] = True
            upto = np.concatenate([[0], np.cumsum(live)])
            met = np.flatnonzero(upto[hi] > upto[lo])
            found = self.postings(blocks[met])
            docs, scores = self.docs[found], np.repeat(weight[met], self.sizes[blocks[met]]) * self.impacts[found]
            kept = live[np.searchsorted(edges, docs, side="right") - 1]
            total = np.zeros(len(self.ids), dtype=np.int64)
            np.add.at(total, docs[kept], scores[kept])
            good = np.flatnonzero((total >= max(least, 1)) & (self.ids != NO_ID))
            if len(good):
                scores, ids = np.concatenate([best[0], total[good]]), np.concatenate([best[1], self.ids[good]])
                ranked = np.lexsort((ids, -scores))[:k]
                best = scores[ranked], ids[ranked]
        return best


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term, times) of the items' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, bounds in batch_words(batch.column(1), IS_TERM):
                row = first + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(words.view(np.int64))], names=["item_id", "term"])

    kind = items.schema[item_id].dataType.simpleString()
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    return rows.mapInArrow(trimmed(run), f"item_id {kind}, term long").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def document_frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many documents each term of the sorted ``vocabulary`` is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                terms, counts = (np.frombuffer(row[c], ARRAYS[c]) for c in ("terms", "counts"))
                _, here, there = np.intersect1d(vocabulary, terms, assume_unique=True, return_indices=True)
                df[here] += counts[there]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["i", "df"])

    out = np.zeros(len(vocabulary), dtype=np.int64)
    for r in index.select("terms", "counts").mapInArrow(trimmed(run), "i long, df long").groupBy("i").agg(F.sum("df").alias("df")).collect():
        out[r["i"]] = r["df"]
    return out


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = TOP, item_id: str = "item_id", text: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores for each item.

    Items are dealt by hash into passes of about ``query_terms`` distinct terms; a pass ships its terms to all tasks.
    """
    spark = index.sparkSession
    asked = written(item_terms(items, item_id, text), "items")
    passes = -(-asked.count() // query_terms)
    kind, out = asked.schema["item_id"].dataType, None
    with arrow_batches(spark, 1):  # a row is a shard
        for p in range(passes):
            rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()
            vocabulary = np.unique(np.array([r["term"] for r in rows], dtype=np.int64).view(np.uint64))
            df = document_frequencies(index, vocabulary)
            weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(x) + 1))) if x else 0 for x in df], dtype=np.int64)
            keys = list(dict.fromkeys(r["item_id"] for r in rows))
            own = {key: ([], []) for key in keys}
            for r in rows:
                t = int(np.searchsorted(vocabulary, np.uint64(r["term"] & (1 << 64) - 1)))
                if weight[t]:
                    own[r["item_id"]][0].append(t)
                    own[r["item_id"]][1].append(int(weight[t]) * r["times"])
            queries = [(np.array(t, dtype=np.int64), np.array(w, dtype=np.int64)) for t, w in own.values()]
            shared = spark.sparkContext.broadcast((vocabulary, queries, keys))
            found = written(_ranked(index, shared, kind, k), "ranked")
            out = found if out is None else out.union(found)
    discard(asked)
    if out is None:
        out = spark.createDataFrame([], f"item_id {kind.simpleString()}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _ranked(index: DataFrame, shared, kind, k: int) -> DataFrame:
    """Each task's best documents for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, queries, keys = shared.value
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(queries)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, vocabulary)
                best = [shard.search(terms, weights, b, k) for (terms, weights), b in zip(queries, best)]
        for at in range(0, len(keys), 1000):
            part = best[at : at + 1000]
            own = pa.array([key for key, b in zip(keys[at:], part) for _ in b[0]], to_arrow)
            yield pa.RecordBatch.from_arrays([own, *[pa.array(np.concatenate([b[c] for b in part])) for c in (1, 0)]], names=["item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    to_arrow = to_arrow_type(kind)
    return index.mapInArrow(trimmed(run), f"item_id {kind.simpleString()}, doc_id long, score long")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    index, n_docs, _ = build_index(documents(spark, sf_dir))
    found = search(index, n_docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    discard(index)
    return found


OP13_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
m AS (SELECT doc_id, 25 + (75 * n * nn) // ll AS m FROM d, s),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, nn),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
