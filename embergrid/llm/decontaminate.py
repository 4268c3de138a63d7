"""Operator 10: benchmark decontamination by pigeonhole edit matching.

Each test item of n characters may be edited ``k = floor(budget * n)`` times. It is cut into
k + 1 pieces; wherever it occurs with at most k edits, one piece stands unchanged. An
Aho-Corasick automaton over the pieces finds these exact hits in whole texts, and Myers'
bit-parallel distance verifies the text around them. Texts and items are compared with A-Z
lower-cased and each run of white space as one space.

Items go in blocks of ``block_chars`` characters, one pass over the documents for each block, so
the automaton that is broadcast has a fixed bound whatever the number of items. Every hit is
verified unless a verified window of its item covers it; nothing is capped.

Defined results: null texts and items match nothing, nor do items without a character other than
white space; items shorter than ``short_chars`` normalised characters must stand unchanged, with no
letter or digit right before or after them; of several occurrences of an item in a text the one with
least distance is returned, then the leftmost end; equal items are each reported, items without an id
under a null id; repeated rows of a document are judged row by row. Extra columns play no part;
keys named item_id, distance or end are an error, as the result has columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches, trimmed, written

BUDGET = 0.08
SHORT_CHARS = 20
BLOCK_CHARS = 4_000_000
FOUND = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal(text: str) -> str:
    return " ".join(text.translate(LOWER).split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` adjacent pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """A test item with its masks for Myers' algorithm."""

    def __init__(self, item_id: int | None, item: str, k: int, short: bool):
        self.item_id, self.n, self.k, self.short = item_id, len(item), k, short
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.high, self.full = 1 << (self.n - 1), (1 << self.n) - 1

    def best(self, text: str) -> tuple[int, int]:
        """The least edit distance of the item to a substring of ``text``, and its leftmost end."""
        positive, negative, score = self.full, 0, self.n
        best, end, full, high, masks = self.n, 0, self.full, self.high, self.masks
        for j, c in enumerate(text):
            eq = masks.get(c, 0)
            x = eq | negative
            d = ((((eq & positive) + positive) ^ positive) | eq) | negative
            ph = negative | ~(d | positive)
            mh = positive & d
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph <<= 1
            mh <<= 1
            positive = (mh | ~(x | ph)) & full
            negative = ph & x & full
            if score < best:
                best, end = score, j + 1
                if not best:
                    break
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], budget: float = BUDGET, short_chars: int = SHORT_CHARS):
        self.patterns: list[Pattern] = []
        self.automaton = ahocorasick.Automaton()
        starts: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = normal(text)
            if item:
                short = len(item) < short_chars
                k = 0 if short else int(budget * len(item))
                for at, piece in pieces(item, k):
                    starts.setdefault(piece, []).append((len(self.patterns), at))
                self.patterns.append(Pattern(item_id, item, k, short))
        for piece, found in starts.items():
            self.automaton.add_word(piece, (len(piece), found))
        if starts:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of each item within its budget."""
        if not text or not self.patterns:
            return []
        text = normal(text)
        windows: dict[int, list[tuple[int, int]]] = {}
        whole: dict[int, int] = {}  # ends of the first occurrences of short items
        for last, (size, found) in self.automaton.iter(text):
            for p, at in found:
                pattern = self.patterns[p]
                if pattern.short:
                    if p not in whole and not (text[last - size : last - size + 1].isalnum() and last >= size or text[last + 1 : last + 2].isalnum()):
                        whole[p] = last + 1
                    continue
                begin = last + 1 - size - at
                window = (max(0, begin - pattern.k), min(len(text), begin + pattern.n + pattern.k))
                own = windows.setdefault(p, [])
                if own and own[-1][0] <= window[0] and window[1] <= own[-1][1]:
                    continue
                if own and window[0] <= own[-1][1]:
                    own[-1] = (min(own[-1][0], window[0]), max(own[-1][1], window[1]))
                else:
                    own.append(window)
        out = [(self.patterns[p].item_id, 0, end) for p, end in whole.items()]
        for p, own in windows.items():
            pattern, found = self.patterns[p], []
            for a, b in own:
                if b - a < pattern.n - pattern.k:
                    continue
                distance, end = pattern.best(text[a:b])
                if distance <= pattern.k:
                    found.append((distance, a + end))
            if found:
                out.append((pattern.item_id, *min(found)))
        return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int):
    """The items in blocks of bounded size, fetched one partition at a time."""
    own, size = [], 0
    for row in benchmark.where(F.col(text).isNotNull()).select(item_id, text).toLocalIterator():
        own.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_chars:
            yield own
            own, size = [], 0
    if own:
        yield own


def matches(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", budget: float = BUDGET, short_chars: int = SHORT_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row (keys, item_id, distance, end) for each document and item it holds."""
    if {k.lower() for k in keys} & {"item_id", "distance", "end"}:
        raise ValueError("keys may not be named item_id, distance or end")
    spark, out = docs.sparkSession, None
    small_batches(spark)
    rows = docs.select(F.struct(*keys).alias("k"), F.col(text).alias("t"))
    for block in item_blocks(benchmark, item_id, item_text, block_chars):
        judge = _udf(spark.sparkContext.broadcast(Matcher(block, budget, short_chars)))
        found = rows.select("k", judge("t").alias("m")).where(F.size("m") > 0)
        found = found.select("k", F.explode("m").alias("m")).select("k.*", "m.item_id", "m.distance", "m.end")
        out = found if out is None else out.union(found)
    none = rows.where("false").select("k.*", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("distance"), F.lit(0).alias("end"))
    return none if out is None else out


def without_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", budget: float = BUDGET, short_chars: int = SHORT_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item; judged row by row, so ids play no part. The kept rows are written after each block of items but the last."""
    spark = docs.sparkSession
    small_batches(spark)
    done = None
    for block in item_blocks(benchmark, item_id, item_text, block_chars):
        if done is not None:
            docs = written(done, "clean")
        judge = _udf(spark.sparkContext.broadcast(Matcher(block, budget, short_chars)))
        done = docs.where(F.size(judge(F.col(text))) == 0)
    return docs if done is None else done


def _udf(shared):
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            own = [[{"item_id": i, "distance": d, "end": e} for i, d, e in shared.value.find(t)] for t in texts.to_pylist()]
            yield pa.array(own, pa.list_(FOUND))

    @F.arrow_udf("array<struct<item_id:bigint,distance:int,end:int>>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from trimmed(found)(batches)

    return judge


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return matches(documents(spark, sf_dir).select("doc_id", "text"), benchmark, ["doc_id"])
