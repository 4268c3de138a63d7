import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from embergrid.llm.filter_audit import filter_audit, plain_changes, text_filters

DOCS = "doc_id long, text string, source string, id string, mask string"
LONG = " ".join(f"w{i}" for i in range(60))


def brute(docs, labels):
    """Every order, document by document."""
    first, good, toxic = {}, set(), set()
    for d, text, *_ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    for d, q, t in labels:
        good |= {d} if q == 1 else set()
        toxic |= {d} if t == 1 else set()
    facts = []
    for d, text, source, *_ in docs:
        x = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", x) if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in x) > 5 * len(x), "D": any(c in "#$%&*|" for c in x), "E": d is not None and d > first[x]}
        facts.append((d, source or "", {f for f, v in fails.items() if v}))
    out, shapley = {}, collections.Counter()
    for part in {p for _, p, _ in facts}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(d, f) for d, p, f in facts if p == part]
            for k, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in left if letter in f]
                every = [f for _, p, f in facts if p == part and letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                shapley[part, letter] += len(gone)
                out[part, order, k] = [len(left), len(gone), len(every) - len(gone), sum(f == {letter} for f in every), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def audit(spark, docs, labels):
    d = spark.createDataFrame(docs, DOCS)
    found = filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), text_filters(F.coalesce("text", F.lit(""))), duplicate="E").collect()
    assert len({r[:3] for r in found}) == len(found)
    return {tuple(r[:3]): tuple(r[3:]) for r in found}


@pytest.mark.parametrize("n", range(1, 6))
def test_plain_changes(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in plain_changes(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_audit(spark):
    texts = [LONG, LONG + " #", "the " * 70, "A B C", None, "", LONG.upper(), "x|y", "the " * 70, LONG, "é" * 30, "word " * 200_000]
    docs = [(i, t, ("s", "t", None, "")[i % 4], "other", "column") for i, t in enumerate(texts)]
    docs += [(None, LONG, "s", "", ""), (None, LONG, "s", "", ""), (3, "A B C", "t", "", ""), (3, "A B C", "t", "", ""), (100, "A B C", "t", "", "")]
    labels = [(0, 1, 0), (1, 0, 1), (3, 0, 1), (3, 1, 0), (4, None, None), (None, 1, 1), (9, 1, 1), (100, 1, 0), (77, 1, 1)]
    found = audit(spark, docs, labels)
    assert found == brute(docs, labels)
    assert len(found) == 600 * len({p for p, _, _ in found})


def test_empty(spark):
    assert audit(spark, [], []) == {}
    one = audit(spark, [(1, None, None, "", "")], [])
    assert len(one) == 600 and one["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_filters_of_any_kind(spark):
    d = spark.createDataFrame([(i, "p", i % 6) for i in range(30)], "doc_id long, source string, v int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filter_audit(d.withColumn("text", F.lit("")), labels, {"x": F.col("v") > 3, "y": F.col("v") % 2 == 0}).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in found} == {("xy", 1): (20, 10, 0, 15), ("xy", 2): (10, 10, 5, 25), ("yx", 1): (15, 15, 0, 25), ("yx", 2): (10, 5, 5, 15)}
    with pytest.raises(ValueError):
        filter_audit(d, labels, {c: F.lit(True) for c in "abcdefghi"})
