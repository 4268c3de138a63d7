"""Operator 9: exact n-gram Jaccard join, size-aware and heavy-light.

Sets are the distinct hashed shingles of a text; equal sets are one vertex (their smallest
doc_id). Two vertices link when 100 * |A & B| >= percent * |A | B|.

* Light: a set of up to ``boundary`` shingles enumerates its subsets of the fixed sizes that a
  link with any partner would need in common. Equal subsets prove the overlap, so one list's
  members all hang on its smallest set. A pair is light if its smaller set is.
* Heavy: larger sets enter inverted lists under a prefix of their shingles, common shingles last;
  a link needs ``SHARED`` prefix shingles in common. Lists are scanned: short ones give all pairs
  of matching sizes, which must share enough lists (long ones in doubt count as shared). A pair
  that shares no short list shares ``SHARED`` long ones, so only members with as many stay there.
  Long lists first give each member a few partners a round, links found are verified and
  contracted to components, and in the end members of different components of one list meet in
  blocks of about ``PAIR_BLOCK`` members of neighbouring sizes, dealt by hash. Odd sketches (one parity
  bit for each of ``SKETCH`` * 64 shingle classes) bound the symmetric difference from below and
  let only close pairs pass to the exact intersection, for sets of more than ``LARGE`` shingles once
  more by sketches of ``LARGE_SKETCH`` * 64 bits. No pair is dropped without a proof that it
  is no link, or that both ends are in one component already.

The boundary is chosen by cost: subsets enumerated against prefix entries times the partners
that a list holds, both estimated on a hashed sample of a sixteenth of the documents (all of a
small table), which also finds the common shingles; the most frequent ``MAX_COMMON`` of them are
broadcast. Sample and common shingles steer only order and cost, never results.

Defined results: no words or a null text: an empty set, linked with nothing, its own component;
fewer words than the width: the whole sequence is one shingle. Rows that repeat a doc_id are one
vertex with the union of their links. Rows with a null doc_id keep a null component. Extra columns
play no part. Thresholds so low that a link of two heavy sets could share fewer than ``SHARED``
shingles are an error.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, small_batches, trimmed, written
from .components import components
from .wordhash import batch_words, mix, shingle_hashes

WIDTH, PERCENT = 5, 80
SAMPLE_SHARE = 1 / 16
MAX_COMMON = 1_000_000
MAX_LIGHT = 14
SHORT_LIST, SHARED = 16, 3
MAX_BROADCAST_IDS = 1_000_000
ROUNDS, PARTNERS = 2, 4
BLOCK, PAIR_BLOCK, SKETCH = 1024, 8192, 16
LARGE, LARGE_SKETCH = 512, 128
BITS = [f"s{k}" for k in range(SKETCH)]


def need(a: int, b: int, percent: int) -> int:
    """The least overlap of linked sets of a and b elements."""
    return -(-percent * (a + b) // (100 + percent))


def sizes_around(s: int, percent: int) -> range:
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def subset_sizes(s: int, boundary: int, percent: int) -> list[int]:
    return sorted({need(s, t, percent) for t in sizes_around(s, percent) if min(s, t) <= boundary})


def choose_boundary(partners: float, percent: int, most: int = MAX_LIGHT) -> int:
    """The largest size whose subsets cost no more than scanning its lists with ``partners`` others each."""
    best = 0
    for s in range(1, most + 1):
        light = sum(math.comb(s, c) for c in subset_sizes(s, s, percent))
        prefix = s - (percent * s + 99) // 100 + SHARED
        if light > prefix * (1 + partners * s) and s > 4:
            break
        best = s
    return best


def sets_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of the text column, which is the second."""
    for first, words, bounds in batch_words(batch.column(1)):
        for i in range(len(bounds) - 1):
            yield first + i, np.unique(shingle_hashes(words[bounds[i] : bounds[i + 1]], width))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _fingerprint(h: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(mix(h)) if len(h) else np.uint64(0)
        b = mix(h + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(h) else np.uint64(0)
    return int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))


def common_shingles(docs: DataFrame, width: int, percent: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Common shingles of a sample (sorted hashes, rank by count) and the partners a list entry meets."""
    share = SAMPLE_SHARE if docs.count() > 20_000 else 1.0
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("shingles")), F.lit(1 << 20)) < int(share * (1 << 20)))

    def shingles(batches):
        for batch in batches:
            rows, sets = [], []
            for _, h in sets_of(batch, width):
                rows.append(_fingerprint(h))
                sets.append(h)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), _lists(sets)], names=["f", "g", "s"])

    once = sample.mapInArrow(trimmed(shingles), "f long, g long, s array<long>").dropDuplicates(["f", "g"])
    counts = written(once.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n")), "sample_counts")
    stats = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") < 4, F.col("n") * (F.col("n") - 1))).alias("pairs")).first()
    partners = (stats["pairs"] or 0) / max(stats["n"] or 1, 1) / max(share, 1e-9)
    common = counts.where("n >= 4").orderBy(F.desc("n"), "h").limit(MAX_COMMON).toArrow()
    discard(counts)
    h, n = (common.column(c).to_numpy() for c in ("h", "n"))
    h = h.view(np.uint64)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(len(h))
    order = np.argsort(h)
    return h[order], rank[order], partners


def prefix_of(h: np.ndarray, common: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    n = len(h)
    p = min(n, n - (percent * n + 99) // 100 + SHARED)
    if not len(common):
        return h[:p]
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    is_common = common[at] == h
    rare = h[~is_common]
    if len(rare) >= p:
        return rare[:p]
    late = h[is_common][np.argsort(rank[at[is_common]], kind="stable")]
    return np.concatenate([rare, late[: p - len(rare)]])


def sketch(h: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """An odd sketch: the parity of each class of shingles; its Hamming distance never exceeds the symmetric difference."""
    odd = np.bincount((h >> np.uint64(64 - (words * 64 - 1).bit_length())).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def subsets_of(h: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    out = []
    for c in subset_sizes(len(h), boundary, percent):
        picks = np.array(list(itertools.combinations(range(len(h)), c)), dtype=np.int64)
        key = np.full(len(picks), c, dtype=np.uint64)
        for k in range(c):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + h[picks[:, k]])
        out.append(key)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def digests(docs: DataFrame, width: int, percent: int, boundary: int, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """Per row: set size, 128-bit fingerprint, prefix (heavy), subset keys (light) and odd sketch."""
    shared = docs.sparkSession.sparkContext.broadcast((common, rank))
    light_to = max(sizes_around(boundary, percent)) if boundary else 0

    def run(batches):
        common, rank = shared.value
        empty = np.zeros(0, np.uint64)
        for batch in batches:
            n, f, g, prefixes, keys, bits = [], [], [], [], [], []
            for _, h in sets_of(batch, width):
                a, b = _fingerprint(h)
                n.append(len(h))
                f.append(a)
                g.append(b)
                prefixes.append(prefix_of(h, common, rank, percent) if len(h) > boundary else empty)
                keys.append(subsets_of(h, boundary, percent) if 0 < len(h) <= light_to else empty)
                bits.append(sketch(h))
            numbers = [pa.array(x, pa.int64()) for x in (n, f, g)]
            bits = np.array(bits, dtype=np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, _lists(prefixes), _lists(keys), *[pa.array(bits[:, k]) for k in range(SKETCH)]], names=["doc_id", "n", "f", "g", "prefix", "keys", *BITS])

    return docs.mapInArrow(trimmed(run), "doc_id long, n long, f long, g long, prefix array<long>, keys array<long>, " + ", ".join(f"{c} long" for c in BITS))


def light_links(vertices: DataFrame, percent: int) -> DataFrame:
    """Pairs with an equal subset: each member with its list's smallest set, which fits wherever a larger one does."""
    rows = vertices.where(F.size("keys") > 0).select("node", "n", F.explode("keys").alias("h"))
    first = rows.groupBy("h").agg(F.min(F.struct("n", "node")).alias("m"), F.count("*").alias("members")).where("members > 1")
    fits = F.least("n", "m.n") * 100 >= F.greatest("n", "m.n") * percent
    return rows.join(first, "h").where((F.col("node") != F.col("m.node")) & fits).select(F.col("m.node").alias("u"), F.col("node").alias("v")).distinct()


def vertex_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The full sets of the wanted vertices, with larger sketches of large ones; their ids are broadcast only up to a checked count."""

    def run(batches):
        for batch in batches:
            sets = [h for _, h in sets_of(batch, width)]
            large = [sketch(h, LARGE_SKETCH).view(np.uint64) if len(h) > LARGE else h[:0] for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in sets], pa.int64()), _lists(sets), _lists(large)], names=["node", "n", "s", "large"])

    wanted = written(wanted.select(F.col("node").alias("doc_id")).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_IDS else wanted
    texts = docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text")
    return written(texts.mapInArrow(trimmed(run), "node long, n long, s array<long>, large array<long>"), "sets")


def _side(bits: DataFrame, node: str, size: str, mark: str) -> DataFrame:
    return bits.select(F.col("node").alias(node), F.col("n").alias(size), *[F.col(c).alias(mark + c) for c in BITS])


def may_link(a: str, b: str, x: str, y: str, percent: int) -> Column:
    """False only for pairs of sizes a, b and sketches x*, y* that are no link."""
    fits = F.least(a, b) * 100 >= F.greatest(a, b) * percent
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in BITS])
    # |A xor B| <= (100 - percent) / (100 + percent) * (|A| + |B|)
    return fits & (apart * (100 + percent) <= (F.col(a) + F.col(b)) * (100 - percent))


def verify(docs: DataFrame, pairs: DataFrame, bits: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets link, by exact intersection, written."""
    both = pairs.select("u", "v").distinct().join(_side(bits, "u", "nu", "x"), "u").join(_side(bits, "v", "nv", "y"), "v")
    close = written(both.where(may_link("nu", "nv", "x", "y", percent)).select("u", "v").distinct(), "close")
    sets = vertex_sets(docs, close.select(F.col("u").alias("node")).union(close.select("v")), width)
    left = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("large").alias("x"))
    right = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("large").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    both = close.join(left, "u").join(right, "v")
    fits = (F.size("x") == 0) | (F.size("y") == 0) | (apart * (100 + percent) <= (F.col("nu") + F.col("nv")) * (100 - percent))
    closer = written(both.where(fits).select("u", "v").distinct(), "close")
    discard(close)
    left = sets.select(F.col("node").alias("u"), F.col("s").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("s").alias("sv"))
    both = closer.join(left, "u").join(right, "v")
    overlap = F.size(F.array_intersect("su", "sv"))
    links = written(both.where(overlap * (100 + percent) >= (F.size("su") + F.size("sv")) * percent).select("u", "v"), "links")
    discard(closer, sets)
    return links


def short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of fitting sizes that share short lists, and with the long ones perhaps ``SHARED`` in all."""
    short = lists.where(F.col("len") <= SHORT_LIST)
    a = short.select("h", F.col("node").alias("u"), F.col("n").alias("na"))
    b = short.select("h", F.col("node").alias("v"), F.col("n").alias("nb"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    shared = a.join(b, "h").where((F.col("u") < F.col("v")) & fits).groupBy("u", "v").agg(F.count("*").alias("k"))
    in_long = lists.where(F.col("len") > SHORT_LIST).groupBy("node").agg(F.count("*").alias("m"))
    for end in ("u", "v"):
        shared = shared.join(in_long.select(F.col("node").alias(end), F.col("m").alias(f"m{end}")), end, "left")
    in_doubt = F.least(F.coalesce("mu", F.lit(0)), F.coalesce("mv", F.lit(0)))
    return shared.where(F.col("k") + in_doubt >= SHARED).select("u", "v")


def octave(size: str, percent: int, shift: float = 0.0) -> Column:
    """Sizes of linked sets are in one octave or in adjacent ones."""
    return F.floor(F.log(F.col(size).cast("double")) / math.log(100 / percent) + shift)


def partners_met(open_lists: DataFrame, percent: int, r: int) -> DataFrame:
    """Each member of a long list with ``PARTNERS`` members of another component; lists are dealt into blocks by hash."""
    spread = F.xxhash64("node", F.lit(r))
    dealt = open_lists.select("h", "node", "n", "comp", octave("n", percent, r / 2).alias("o"), F.pmod(F.shiftright(spread, 20), F.ceil(F.col("len") / BLOCK)).alias("block"), spread.alias("at"))
    w = Window.partitionBy("h", "o", "block").orderBy("at", "node")
    tried = F.array(*[F.lead(F.struct("node", "n", "comp"), k).over(w) for k in range(1, PARTNERS + 1)])
    met = dealt.select("node", "n", "comp", tried.alias("tried")).select("node", "n", "comp", F.explode("tried").alias("o"))
    met = met.where("o is not null and o.comp <> comp").where(F.least("n", "o.n") * 100 >= F.greatest("n", "o.n") * percent)
    return met.select(F.least("node", "o.node").alias("u"), F.greatest("node", "o.node").alias("v"))


def block_pairs(open_lists: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components of one list that may link; at least one is outside of the list's largest component."""
    sums = open_lists.groupBy("h", "comp").count().groupBy("h").agg(F.max_by("comp", F.struct("count", "comp")).alias("most"), F.sum("count").alias("every"))
    sums = sums.select("h", "most", F.ceil(F.col("every") / PAIR_BLOCK).alias("blocks"))
    rows = open_lists.select("h", "node", "comp").join(sums, "h").join(bits, "node")
    rows = rows.withColumns({"o": octave("n", percent), "block": F.pmod(F.xxhash64("node"), F.col("blocks"))})
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    own = lambda mark: [F.col(c).alias(mark + c) for c in ("node", "n", "comp", *BITS)]
    left = rows.where("comp <> most").select("h", F.col("block").alias("i"), "blocks", F.explode(F.array(*[F.col("o") + k for k in (-1, 0, 1)])).alias("o"), *own("x"))
    left = left.select("h", "o", "i", F.explode(every).alias("j"), *[c for c in left.columns if c.startswith("x")])
    right = rows.select("h", "o", F.col("block").alias("j"), F.explode(every).alias("i"), *own("y"))
    both = left.join(right, ["h", "o", "i", "j"]).where(F.col("xcomp") != F.col("ycomp")).where(may_link("xn", "yn", "x", "y", percent))
    return both.select(F.least("xnode", "ynode").alias("u"), F.greatest("xnode", "ynode").alias("v"))


def heavy_links(docs: DataFrame, posts: DataFrame, known: DataFrame, bits: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Links between vertices that share lists, those among the ``known`` pairs, and the components of them all if they are known."""
    counts = posts.groupBy("h").agg(F.count("*").alias("len")).where("len > 1")
    lists = written(posts.join(counts, "h"), "lists")
    pairs = short_pairs(lists, percent).union(known.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    links = verify(docs, pairs, bits, width, percent)
    long_lists = lists.where(F.col("len") > SHORT_LIST)
    enough = long_lists.groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") >= SHARED).select("node")
    long_lists = written(long_lists.join(enough, "node", "left_semi"), "long")
    discard(lists)
    comp, empty = None, long_lists.isEmpty()
    for r in range(0 if empty else ROUNDS + 1):
        discard(comp)
        comp = components(links)
        labelled = long_lists.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        split = labelled.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
        open_lists = written(labelled.join(split, "h", "left_semi"), "open")
        if open_lists.isEmpty():
            return links, comp
        more = verify(docs, partners_met(open_lists, percent, r) if r < ROUNDS else block_pairs(open_lists, bits, percent), bits, width, percent)
        links = links.union(more)
        discard(open_lists)
    discard(comp, long_lists)
    return links, None


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    common, rank, partners = common_shingles(docs, width, percent)
    boundary = choose_boundary(partners, percent)
    if need(boundary + 1, boundary + 1, percent) < SHARED:
        raise ValueError(f"a threshold of {percent} % is too low for lists of {SHARED} shared shingles")
    rows = written(digests(docs, width, percent, boundary, common, rank), "digests")
    ids = rows.where("doc_id is not null and n > 0")
    classes = written(ids.groupBy("n", "f", "g").agg(F.min("doc_id").alias("node")), "classes")
    # one row for each class: rows of one doc_id and one set are equal
    own = F.struct("n", "f", "g")
    vertices = ids.join(classes.select("node", own.alias("c")), (F.col("doc_id") == F.col("node")) & (own == F.col("c")), "left_semi").withColumnRenamed("doc_id", "node")
    posts = vertices.where(F.size("prefix") > 0).select("node", "n", F.explode("prefix").alias("h"))
    bits = rows.select(F.col("doc_id").alias("node"), "n", *BITS)
    links, found = heavy_links(docs, posts, light_links(vertices, percent), bits, width, percent)
    member = rows.select("doc_id", "n", "f", "g").join(classes, ["n", "f", "g"], "left")
    # rows of one doc_id with different sets are one vertex: link their classes
    repeated = member.where("node is not null").groupBy("doc_id").agg(F.countDistinct("node").alias("k")).where("k > 1").select(F.col("doc_id").alias("u"))
    if not repeated.isEmpty():
        same = member.where("node <> doc_id").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
        links, found = links.union(same.join(repeated, "u", "left_semi")), None
    if found is None:
        found = components(links)
    out = member.join(found.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d
), s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
c(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.v, c.root FROM c JOIN e ON e.u = c.id WHERE c.root < e.v)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id GROUP BY ALL
"""
