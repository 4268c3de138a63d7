"""Placement, searches for many pairs, bridges and as-of joins against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from embergrid.operators.asof import as_of_join
from embergrid.operators.assignment import auction, unhappy
from embergrid.operators.bridges import bridges, spanning_forest
from embergrid.operators.paths import k_shortest_paths, tight_arcs, tied_paths, two_sided_paths

LINKS = "src long, dst long, w double"


def graph(seed, n, m, weights=(1, 2, 3)):
    rng = random.Random(seed)
    found = {}
    while len(found) < m:
        u, v = rng.sample(range(n), 2)
        found[min(u, v), max(u, v)] = float(rng.choice(weights))
    return [(u, v, w) for (u, v), w in found.items()]


def simple_paths(links, s, t, directed=False):
    near = {}
    for u, v, w in links:
        near.setdefault(u, {})[v] = min(w, near.get(u, {}).get(v, w))
        if not directed:
            near.setdefault(v, {})[u] = min(w, near.get(v, {}).get(u, w))

    def grow(path, cost):
        if path[-1] == t:
            yield cost, len(path) - 1, path
            return
        for v, w in near.get(path[-1], {}).items():
            if v not in path:
                yield from grow([*path, v], cost + w)

    return sorted(grow([s], 0.0))


def best_total(pairs, slots):
    """The best placement, person by person."""
    people = sorted({p for p, _, _ in pairs})

    def grow(i, left):
        if i == len(people):
            return 0
        out = grow(i + 1, left)
        for p, o, b in pairs:
            if p == people[i] and left.get(o, 0):
                out = max(out, b + grow(i + 1, left | {o: left[o] - 1}))
        return out

    return grow(0, dict(slots))


@pytest.mark.parametrize("seed", range(2))
def test_auction_is_exact_with_whole_benefits(spark, seed):
    rng = random.Random(seed)
    pairs = [(p, o, rng.randint(1, 9)) for p in range(6) for o in range(4) if rng.random() < 0.8]
    slots = [(0, 1), (1, 2), (2, rng.randint(0, 1)), (3, 1)]
    found = auction(spark.createDataFrame(pairs, "person long, object long, benefit int"), spark.createDataFrame(slots, "object long, slots int"), 1 / 7)
    placed = [tuple(r) for r in found.placed.collect()]
    assert found.primal == sum(b for *_, b in placed) == best_total(pairs, slots)
    assert found.primal <= found.dual <= found.primal + 6 / 7
    assert len({p for p, *_ in placed}) == len(placed) and all(sum(o == q for _, q, _ in placed) <= k for o, k in slots)


def test_auction_sends_two_offers_of_a_person_at_most(spark, monkeypatch):
    """While many persons wait, pairs meet no table of persons before all but two offers of each are gone; when few do, others' pairs are dropped first."""
    from embergrid.operators import assignment

    plans, saved = [], assignment.saved
    monkeypatch.setattr(assignment, "saved", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), saved(df))[1])
    pairs = [(p, o, 1 + (7 * p + 3 * o) % 50) for p in range(40) for o in range(5)]
    found = auction(spark.createDataFrame(pairs, "person long, object long, benefit int"), spark.createDataFrame([(o, 3) for o in range(5)], "object long, slots int"), 4.0)
    bids = [p for p in plans if "DESC" in p and "value" in p]
    semi = ["LeftSemi" in p for p in bids]
    assert found.rounds == len(bids) > 2 and not any(semi[:2]) and semi[-1]
    assert 0 <= found.dual - found.primal <= 4.0 * 40 and found.placed.count() <= 15


def test_auction_bounds_what_it_leaves(spark):
    rng = random.Random(9)
    pairs = [(p, o, rng.randint(1, 100)) for p in range(60) for o in rng.sample(range(8), 5)]
    frame, slots = spark.createDataFrame(pairs, "person long, object long, benefit int"), spark.createDataFrame([(o, 3) for o in range(8)], "object long, slots int")
    whole = auction(frame, slots, 2.0)
    assert whole.primal <= whole.dual <= whole.primal + 2.0 * 60 and whole.placed.count() == 24
    assert unhappy(frame, whole.prices, whole.placed, 2.0).isEmpty()
    short = auction(frame, slots, 2.0, rounds=2)
    assert short.rounds == 2 and short.dual >= whole.primal
    none = auction(frame.where("false"), slots, 1.0)
    assert (none.primal, none.dual, none.placed.count()) == (0.0, 0.0, 0)
    with pytest.raises(ValueError):
        auction(frame, slots, 0)


@pytest.mark.parametrize("max_hops", [None, 3])
def test_k_shortest(spark, max_hops):
    links = graph(1, 8, 14)
    pairs = [(0, 5), (1, 7), (2, 2), (3, 99), (0, 5), (6, 4)]
    got = k_shortest_paths(spark.createDataFrame(links, LINKS), spark.createDataFrame(pairs, "source long, target long"), 5, "w", max_hops).collect()
    want = [(s, t, r, c, p) for s, t in set(pairs) for r, (c, _, p) in enumerate([x for x in simple_paths(links, s, t) if max_hops is None or x[1] <= max_hops][:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_k_shortest_directed_with_no_weight(spark):
    links = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (2, 0, 0.0), (2, 3, 1.0), (1, 3, 0.0), (1, 3, 5.0), (3, 3, 1.0)]
    frame, pairs = spark.createDataFrame(links, LINKS), spark.createDataFrame([(0, 3), (3, 0)], "source long, target long")
    got = k_shortest_paths(frame, pairs, 9, "w", directed=True).collect()
    assert [(r.rank, r.cost, r.path) for r in sorted(got)] == [(k, c, p) for k, (c, _, p) in enumerate(simple_paths(links, 0, 3, True), 1)]
    assert k_shortest_paths(frame, pairs.where("false"), 2, "w").collect() == []
    with pytest.raises(ValueError):
        k_shortest_paths(spark.createDataFrame([(0, 1, -1.0)], LINKS), pairs, 1, "w")


@pytest.mark.parametrize("directed", [False, True])
def test_two_sided(spark, directed):
    links = graph(3, 14, 26, (0, 1, 2, 5)) + [(50, 51, 1.0)]
    pairs = [(s, t) for s in range(14) for t in range(14)] + [(0, 50), (50, 51), (99, 0)]
    got = {(r.source, r.target): r for r in two_sided_paths(spark.createDataFrame(links, LINKS), spark.createDataFrame(pairs, "source long, target long"), "w", directed).collect()}
    least = {(u, v): w for u, v, w in links} | ({} if directed else {(v, u): w for u, v, w in links})
    for s, t in pairs:
        found = simple_paths(links, s, t, directed)
        if not found or (s, t) == (99, 0):
            assert (s, t) not in got
            continue
        row = got[s, t]
        assert row.distance == found[0][0] and row.path[0] == s and row.path[-1] == t
        assert sum(least[a, b] for a, b in zip(row.path, row.path[1:])) == row.distance


def test_two_sided_settles_fewer_nodes(spark):
    """On a grid, both searches together settle less than a search from one end up to the target."""
    links = [(25 * r + c, 25 * r + c + 1, 1.0) for r in range(25) for c in range(24)] + [(25 * r + c, 25 * r + c + 25, 1.0) for r in range(24) for c in range(25)]
    row = two_sided_paths(spark.createDataFrame(links, LINKS), spark.createDataFrame([(312, 322)], "source long, target long"), "w").first()
    one_sided = sum(abs(r - 12) + abs(c - 12) < 10 for r in range(25) for c in range(25))
    assert row.distance == 10 and row.settled < one_sided


def test_two_sided_ends_where_one_more_arc_is_too_much(spark):
    """No node beside the ends is settled once an open node of either side and the least arc reach the path found."""
    links = [(0, p, 1.0 + p % 2) for p in range(10, 30)] + [(1, p, 2.0 - p % 2) for p in range(10, 30)] + [(s, p, 1.0) for s in range(100, 105) for p in range(10, 30)]
    row = two_sided_paths(spark.createDataFrame(links, LINKS), spark.createDataFrame([(0, 1)], "source long, target long"), "w").first()
    assert row.distance == 3 and len(row.path) == 3 and row.settled == 2


def test_two_sided_leaves_heavy_arcs_until_they_are_needed(spark, monkeypatch):
    """Rows of labels follow what is within reach of a pair, not the degrees of its ends; tables of past rounds are deleted."""
    import glob

    from embergrid.operators import paths, storage

    held = []
    monkeypatch.setattr(paths, "saved", lambda df: (held.append(storage.saved(df)), held[-1])[1])
    links = [(e, 10, 1.0) for e in (0, 1)] + [(e, p, 50.0) for e in (0, 1) for p in range(100, 200)] + [(1000 + i, 1001 + i, 1.0) for i in range(60)]
    links += [(2, 300, 40.0), (300, 3, 45.0), (5, 6, 1.0)]
    asked = [(0, 1), (2, 3), (2, 0), (1000, 1060), (6, 5)]
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    found = two_sided_paths(spark.createDataFrame(links, LINKS), spark.createDataFrame(asked, "source long, target long"), "w").collect()
    assert {(r.source, r.target): (r.distance, len(r.path)) for r in found} == {(0, 1): (2.0, 3), (2, 3): (85.0, 3), (1000, 1060): (60.0, 61), (6, 5): (1.0, 2)}
    labels = [df for df in held if "f_at" in df.columns]
    left = [df for df in labels if glob.glob(df._saved_in.removeprefix("file:"))]
    assert len(labels) > 10 and all(df.isEmpty() for df in left) and spark.conf.get(key) == before
    # (0, 1) alone would make 200 rows in its first round
    held.clear()
    monkeypatch.setattr(paths, "dropped", lambda *_: None)
    two_sided_paths(spark.createDataFrame(links, LINKS), spark.createDataFrame(asked[:1], "source long, target long"), "w").collect()
    assert max(df.count() for df in held if "f_at" in df.columns) <= 3


def test_tied_paths(spark):
    links = graph(5, 9, 18, (1, 2))
    pairs = [(s, t) for s in range(9) for t in range(9)] + [(0, 77)]
    frame, asked = spark.createDataFrame(links, LINKS), spark.createDataFrame(pairs, "source long, target long")
    want = []
    for s, t in pairs:
        found = simple_paths(links, s, t) if t != 77 else []
        want += [(s, t, c, tuple(p)) for c, _, p in found if c == found[0][0]]
    got = tied_paths(frame, asked, "w").collect()
    assert sorted((r.source, r.target, r.distance, tuple(r.path)) for r in got) == sorted(want)
    counts = {(r.source, r.target): r.paths for r in tight_arcs(frame, asked, "w")[1].collect()}
    assert counts == {k: len(list(g)) for k, g in itertools.groupby(sorted((s, t) for s, t, *_ in want))}
    assert max(counts.values()) > 1
    with pytest.raises(ValueError):
        tied_paths(frame, asked, "w", most=1)
    with pytest.raises(ValueError):
        tied_paths(spark.createDataFrame([(0, 1, 0.0)], LINKS), asked, "w")


def parts(links, nodes):
    root = {v: v for v in nodes}
    for u, v in links:
        a, b = root[u], root[v]
        root = {k: a if r == b else r for k, r in root.items()}
    return len(set(root.values()))


def test_bridges(spark):
    """Several graphs side by side: random ones, a path, a star, a loop, repeated and turned links, a long path with a cycle."""
    links = [(1000 * k + u, 1000 * k + v) for k, (n, m) in enumerate([(12, 13), (30, 32), (25, 14), (10, 30)]) for u, v, _ in graph(k, n, m)]
    links += [(7100 + i, 7101 + i) for i in range(12)] + [(7200, 7201 + i) for i in range(5)]
    deep = [(9000 + i, 9001 + i) for i in range(300)] + [(9000, 9150)]
    nodes = {v for x in links for v in x}
    rng = random.Random(0)
    given = [x if rng.random() < 0.5 else x[::-1] for x in links + links[:3] + deep] + [(7, 7)]
    frame = spark.createDataFrame(given, "src long, dst long")
    whole = parts(links, nodes)
    want = [x for x in links if parts([y for y in links if y != x], nodes) > whole] + [(9000 + i, 9001 + i) for i in range(150, 300)]
    assert sorted(map(tuple, bridges(frame).collect())) == sorted(want)
    forest, labels = spanning_forest(frame)
    tree = [tuple(r) for r in forest.collect() if r.src < 9000]
    assert len(tree) == len(nodes) - whole and parts(tree, nodes) == whole and set(tree) <= set(links)
    assert labels.select("component").distinct().count() == whole + 1
    assert bridges(frame.where("src = dst")).collect() == []


def test_bridges_draw_cycles_together(spark, monkeypatch):
    """Of well connected parts, links between them and links that hang on them nothing is left for the tour; many small graphs side by side."""
    import importlib

    module = importlib.import_module("embergrid.operators.bridges")
    toured, tour = [], module.euler_tour
    monkeypatch.setattr(module, "euler_tour", lambda forest, labels: (toured.append(forest.count()), tour(forest, labels))[1])
    dense = [(1000 * k + u, 1000 * k + 100 + v) for k in range(3) for u in range(6) for v in range(20) if (u + v) % 4]
    twice, once = [(0, 1100), (1, 1101)], [(1002, 2103)]
    tips = [(1000 * k + u, 5000 + 1000 * k + u) for k in range(3) for u in range(6)]
    found = bridges(spark.createDataFrame(dense + twice + once + tips, "src long, dst long"))
    assert sorted(map(tuple, found.collect())) == sorted(once + tips) and toured == []
    links, want = [], []
    for k in range(40):
        n = 4 + k % 9
        own = [(100 * k + u, 100 * k + v) for u, v, _ in graph(k, n, min(n - 1 + k % 4, n * (n - 1) // 2))]
        nodes = {v for x in own for v in x}
        links += own
        want += [x for x in own if parts([y for y in own if y != x], nodes) > parts(own, nodes)]
    assert sorted(map(tuple, bridges(spark.createDataFrame(links, "src long, dst long")).collect())) == sorted(want)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, strict):
    """A hot key over many ranges, ties, keys on one side only, nulls."""
    rng = random.Random(2)
    key = lambda: 1 if rng.random() < 0.6 else rng.choice([2, 3, 4, None])
    left = [(i, key(), rng.choice([None, *range(40)])) for i in range(300)]
    right = [(1000 + i, key() if rng.random() < 0.9 else 9, rng.choice([None, *range(0, 40, 3)]), f"v{i}" if i % 5 else None) for i in range(120)]
    right += [(2000, 1, 0, "first")]
    r = spark.createDataFrame(right, "rid long, k int, t int, v string")
    found = as_of_join(spark.createDataFrame(left, "lid long, k int, t int"), r, ["k"], "t", "rid", ["rid", "v"], strict, ranges=16).collect()
    want = []
    for i, k, t in left:
        seen = [(rt, rid, v) for rid, rk, rt, v in right if None not in (k, t, rt) and rk == k and (rt < t if strict else rt <= t)]
        _, rid, v = max(seen, key=lambda x: x[:2], default=(None, None, None))
        want.append((i, k, t, rid, v))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        as_of_join(r, r, ["k"], "t", "rid", ["rid"])


def test_as_of_splits_a_hot_key(spark):
    """One key's rows lie in many ranges, none with more than a few times its share, and its last value is carried over ranges without any."""
    left = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.createDataFrame([(1, -1, 7)], "k int, t long, rid long")
    found = as_of_join(left, right, ["k"], "t", "rid", ["rid"], ranges=8)
    assert found.groupBy("rid").count().collect() == [(7, 4000)]
    parts = left.repartitionByRange(8, "k", "t").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 4 and max(n for _, n in parts) < 1500
