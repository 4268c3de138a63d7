import collections
import math
import random
import re

import numpy as np
import pytest

from embergrid.llm.common import arrow_batches
from embergrid.llm.lexical_search import ARRAYS, BLOCK, Shard, build_index, get, pack_shard, put, search, spans, widths

DOCS = "doc_id long, text string, score string, first string"
ITEMS = "item_id long, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """Every document scored for every item."""
    bags = [(d, collections.Counter(terms(t))) for d, t, *_ in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    asked = collections.defaultdict(collections.Counter)
    for i, text in {(i, t) for i, t, *_ in items}:
        asked[i].update(terms(text))
    out = []
    for i, query in asked.items():
        found = []
        for d, b in bags:
            if not b or d is None:
                continue
            m = 25 + 75 * sum(b.values()) * n_docs // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, times in query.items() if b[t])
            if score > 0:
                found.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, shard_bytes=16 << 20, **more):
    index, n_docs, _ = build_index(spark.createDataFrame([(d, t, "", "") for d, t in docs], DOCS).repartition(3), shard_bytes=shard_bytes)
    return sorted(map(tuple, search(index, n_docs, spark.createDataFrame([(i, t, "") for i, t in items], ITEMS), **more).collect()), key=repr)


def corpus(seed, n, vocabulary=400, longest=60):
    rng = random.Random(seed)
    word = lambda: f"w{int(vocabulary * rng.random() ** 3)}"
    docs = [(i, " ".join(word() for _ in range(rng.choice((0, 1, 5, longest, longest * rng.choice((1, 1, 20))))))) for i in range(n)]
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(12)]
    return docs + [(n + i, docs[i][1]) for i in range(0, n, 7)], items


@pytest.mark.parametrize("shard_bytes", [1, 1 << 24])
def test_ranks(spark, shard_bytes):
    docs, items = corpus(1, 500)
    assert run(spark, docs, items, shard_bytes) == brute(docs, items)


def test_passes_and_fewer(spark):
    docs, items = corpus(2, 200)
    assert run(spark, docs, items, query_terms=5) == brute(docs, items)
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "  ...!"), (4, "One two"), (5, "one TWO"), (None, "one two"), (6, "ONE, two; Straße ÄB äb 😀x"), (7, "x " * 300_000 + "rare"), (8, "a\x00b\x7fc"), (4, "one two"), (9, "𐐀 é日本")]
    items = [(1, "one two"), (1, "one two"), (2, None), (3, "?"), (4, "absent"), (5, "rare x x x"), (None, "one"), (6, "ÄB 😀X straße c"), (7, "one"), (7, "é日本 é日本")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(1000 + i, f"other{i}") for i in range(400)]
    found = run(spark, docs, [(1, "words")], 1)
    assert sorted((r, d) for _, r, d, _ in found) == [(r, r) for r in range(1, 11)]


def test_blocks_are_skipped(spark):
    """Blocks under the threshold are never decompressed, and the ranks are right all the same."""
    rng = np.random.RandomState(0)
    words, doc = [], []
    for d in range(20_000):
        own = [1] * (1 + (d % 97 == 0) * 30) + [2] * (d % 3 == 0) + [3] * (d in (777, 13_000)) + [1000 + d] * rng.randint(1, 40)
        words += own
        doc += [d] * len(own)
    packed = pack_shard(np.arange(20_000), np.array(doc), np.array(words, dtype=np.uint64), 20_000, len(words))
    shard = Shard({c: packed[c].astype(k).tobytes() for c, k in ARRAYS.items()}, np.array([1, 2, 3], dtype=np.uint64))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    scores, ids = shard.search(np.array([0, 1, 2]), np.array([1, 400, 9000]), none, 2)
    assert sorted(ids) == [777, 13_000]
    assert 0 < shard.open.sum() < len(shard.open) / 2
    before = shard.open.sum()
    assert shard.search(np.array([0]), np.array([1]), (np.array([10**12, 10**12]), np.array([1, 2])), 2)[0].tolist() == [10**12] * 2 and shard.open.sum() == before


def test_blocks_round_trip():
    rng = np.random.RandomState(1)
    for high in (2, 300, 70_000):
        doc = np.sort(rng.randint(0, high, 5000))
        words = rng.randint(0, 9, 5000).astype(np.uint64)
        packed = pack_shard(np.arange(high), doc, words, high, 5000)
        shard = Shard({c: packed[c].astype(k).tobytes() for c, k in ARRAYS.items()}, np.arange(9, dtype=np.uint64))
        for t in range(9):
            blocks = np.arange(shard.term_blocks[t], shard.term_blocks[t + 1])
            own = collections.Counter(packed["ids"][shard.docs[shard.postings(blocks)]].tolist())
            assert sorted(own) == sorted(set(doc[words == t].tolist())) and max(own.values()) == 1
            assert len(blocks) == -(-len(own) // BLOCK)
            for b in blocks:
                assert shard.impacts[shard.postings(np.array([b]))].max() == shard.top[b]
    values = np.array([0, 255, 256, 65_535, 65_536, 2**31 - 1])
    data, width = np.zeros(24, np.uint8), widths(values)
    put(data, np.arange(6) * 4, values, width)
    assert get(data, np.arange(6) * 4, width).tolist() == values.tolist() and width.tolist() == [1, 1, 2, 2, 4, 4]
    assert spans(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_session_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with arrow_batches(spark, 3):
        assert spark.conf.get(key) == "3"
    assert spark.conf.get(key) == before
