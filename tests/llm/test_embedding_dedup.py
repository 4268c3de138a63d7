import numpy as np
import pytest

from embergrid.llm.embedding_dedup import Tile, compare, embedding_duplicates, joined, linked, pca_bases

SCHEMA = "vec_id long, embedding array<float>, label int, x string, tile string"


def brute(rows, threshold=0.93):
    """All pairs of sound vectors of one label, each cosine in double precision."""
    rows = list({(i, None if e is None else tuple(e), l): (i, e, l) for i, e, l, *_ in rows}.values())
    sound = []
    for k, (i, e, l) in enumerate(rows):
        x = None if e is None or any(c is None for c in e) else np.array(e, dtype=np.float32).astype(float)
        if i is not None and l is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            sound.append((k, l, x))
    links, root = [0] * len(rows), {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (k, l, x) in enumerate(sound):
        for m, o, y in sound[a + 1 :]:
            if l == o and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[k] += 1
                links[m] += 1
                u, v = find(rows[k][0]), find(rows[m][0])
                root[max(u, v)] = min(u, v)
    return sorted(((i, links[k], None if i is None else find(i), None if i is None else find(i) == i) for k, (i, _, _) in enumerate(rows)), key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, None if e is None else [None if c is None else float(c) for c in e], l, "", "") for i, e, l in rows], SCHEMA)
    return sorted(map(tuple, embedding_duplicates(df, **more).collect()), key=repr)


def sample(seed, n, d, spread):
    """Random directions, near copies round some of them, exact copies."""
    rng = np.random.RandomState(seed)
    base = rng.randn(n, d)
    base[n // 2 :] = base[rng.randint(0, n // 4, n - n // 2)] + spread * rng.randn(n - n // 2, d)
    base[-n // 8 :] = base[0]
    return [(int(i), base[i].astype(np.float32).tolist(), int(rng.randint(3))) for i in rng.permutation(n)]


@pytest.mark.parametrize("d, spread", [(1, 0.1), (7, 0.3), (64, 0.35)])
def test_pairs(spark, d, spread):
    rows = sample(d, 240, d, spread)
    want = brute(rows)
    assert run(spark, rows) == want
    assert sum(r[1] for r in want) > 100 and len({r[2] for r in want}) > 3


def test_many_tiles(spark):
    """Tiles of 64 rows give the same as one tile, also of many near copies."""
    rows = sample(5, 500, 16, 0.2)
    rows += [(1000 + k, (np.ones(16) + 0.01 * np.random.RandomState(k).randn(16)).tolist(), 1) for k in range(200)]
    assert run(spark, rows, tile_bytes=1) == run(spark, rows) == brute(rows)


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, None, 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 3.0], 0), (5, [1.0, float("nan"), 3.0], 0), (6, [float("inf"), 2.0, 3.0], 0), (7, v, None), (8, [], 0), (None, v, 0), (9, [2.0, 4.0, 6.0], 0), (9, [2.0, 4.0, 6.0], 0), (10, v[:2], 0), (11, v, 1), (12, [-1.0, -2.0, -3.0], 0), (13, [1e-30, 2e-30, 3e-30], 0), (14, [-0.0, 1.0, 0.0], 2), (15, [0.0, 1.0, -0.0], 2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_vectors_that_share_an_id(spark):
    found = run(spark, [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0)])
    assert {(i, c) for i, _, c, _ in found} == {(1, 1), (2, 1), (3, 1)}


def test_doubles(spark):
    df = spark.createDataFrame([(1, [1e-200, 1e-200], "a"), (2, [1e200, 1e200], "a"), (3, [1.0, 0.0], "a")], "vec_id long, embedding array<double>, label string")
    assert sorted(map(tuple, embedding_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_threshold_and_tiles():
    """Pairs within rounding of the threshold are decided by the given dimensions; strips and whole agree with a plain product."""
    rng = np.random.RandomState(0)
    x = rng.randn(700, 24).astype("<f4")
    x[350:] = x[:350] + 0.3 * rng.randn(350, 24)
    row = {"d": 24, "ids": np.arange(700, dtype="<i8").tobytes(), "weights": np.ones(700, dtype="<i8").tobytes(), "vectors": x.tobytes()}
    turned = np.linalg.qr(rng.randn(24, 24))[0]
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    threshold = float(np.sort((y @ y.T)[np.triu_indices(700, 1)])[-200])
    for bases in ({}, {24: turned}):
        tile = Tile(row, bases)
        i, j = linked(tile, tile, slice(0, 700), threshold)
        want = {(a, b) for a, b in zip(*np.nonzero(y @ y.T >= threshold + 1e-12)) if a < b}
        assert want <= {(a, b) for a, b in zip(i, j) if a < b} and sum(a < b for a, b in zip(i, j)) <= len(want) + 1
        out = compare(tile, None, threshold).to_pylist()
        assert sum(r["n"] for r in out if r["v"] is None) == 2 * sum(a < b for a, b in zip(i, j))


def test_joined():
    rng = np.random.RandomState(1)
    for _ in range(50):
        labels, root = np.arange(60), list(range(60))
        for _ in range(3):
            u, v = rng.randint(0, 60, (2, 15))
            labels = joined(labels, u, v)
            for a, b in zip(u, v):
                a, b = root[a], root[b]
                root = [min(a, b) if r in (a, b) else r for r in root]
        assert labels.tolist() == root


def test_basis_holds_the_length(spark):
    rng = np.random.RandomState(3)
    x = rng.randn(300, 6) * np.array([9, 1, 5, 0.1, 3, 0.5])
    x /= np.linalg.norm(x, axis=1)[:, None]
    basis = pca_bases(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>"))[6]
    held = ((x @ basis) ** 2).sum(axis=0)
    assert np.allclose(basis.T @ basis, np.eye(6)) and (np.diff(held) < 1e-9).all() and np.allclose(held, np.linalg.eigvalsh(x.T @ x)[::-1])
