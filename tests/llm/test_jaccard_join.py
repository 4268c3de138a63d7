import random
import re

import pytest

from embergrid.llm import jaccard_join as J


def brute(rows):
    sets = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), root(d) if d is not None else None) for d, s in sets), key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    return sorted((tuple(r) for r in J.jaccard_components(df).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):  # groups of near copies of any size, small sets too
        base = rng.choices(vocab, k=rng.choice([3, 5, 6, 8, 9, 11, 14, 20, 60, 200]))
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w += rng.choices(vocab, k=rng.choice([1, 3]))
            rows.append(" ".join(w).replace("w1", "W1"))
    passage = " ".join(rng.choices(vocab, k=30))
    rows += [passage + " " + " ".join(rng.choices(vocab, k=rng.choice([2, 4, 10]))) for _ in range(30)]
    rows += [None, "", " \n ", "one", "ONE", "one two", "a\x0bb c", "a b\tc", "é É x y z"]
    rng.shuffle(rows)
    rows = list(enumerate(rows)) + [(3, rows[9]), (3, rows[3]), (None, "one"), (7, None)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("short, rounds, block", [(2, 0, 4), (2, 1, 7), (2, 2, 1024)])
def test_long_lists(spark, monkeypatch, short, rounds, block):
    monkeypatch.setattr(J, "SHORT_LIST", short)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "PAIR_BLOCK", block)
    monkeypatch.setattr(J, "LARGE", 60)
    rng = random.Random(8)
    base, rows = [f"b{i}" for i in range(80)], []
    for i in range(60):
        w = list(base)
        for k in range(rng.choice([1, 2, 3, 4, 6])):
            w[rng.randrange(80)] = f"x{i}_{k}"
        rows.append((i + 10, " ".join(w)))
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_boundary_follows_cost():
    assert J.choose_boundary(0.0, 80) <= J.choose_boundary(50.0, 80) <= J.MAX_LIGHT


def test_sketches_bound_the_symmetric_difference():
    rng = random.Random(3)
    for n in (1, 40, 900):
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), n // 2)) | {rng.getrandbits(64) for _ in range(n // 3)}
        x, y = (J.sketch(J.np.array(sorted(s), dtype=J.np.uint64)) for s in (a, b))
        assert sum(bin((int(p) ^ int(q)) & (1 << 64) - 1).count("1") for p, q in zip(x, y)) <= len(a ^ b)
        assert not (x ^ x).any()


def test_low_thresholds_are_an_error(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    with pytest.raises(ValueError):
        J.jaccard_components(df, percent=10)
