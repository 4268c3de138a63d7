"""Rankings against plain numpy."""

import numpy as np

from embergrid.operators import ranking


def test_grc_runs_to_its_fixed_point(spark):
    links = [(0, 1, 3), (1, 2, 1), (2, 3, 5), (3, 0, 2), (1, 3, 4), (4, 5, 1)]
    cpu = {i: 10.0 + 7 * i for i in range(6)}
    m = np.zeros((6, 6))
    for u, v, w in links:
        m[u, v] += w
        m[v, u] += w
    m /= m.sum(axis=1, keepdims=True)
    c = np.array([cpu[i] for i in range(6)])
    c /= c.sum()
    want = np.linalg.solve(np.eye(6) - 0.85 * m.T, 0.15 * c)
    nodes = spark.createDataFrame(list(cpu.items()), "id long, cpu double")
    got = ranking.rank_grc(nodes, spark.createDataFrame(links, "src long, dst long, bw long"), ["cpu"], "bw").collect()
    assert np.allclose([r["score"] for r in sorted(got, key=lambda r: r["id"])], want, atol=1e-4)


def test_best_offer(spark):
    """The best offer of each demand's group, against all pairs; ties, nulls, groups on one side, a hot group over ranges."""
    import random

    from pyspark.sql import functions as F

    from embergrid.operators.ranking import best_offer

    rng = random.Random(0)
    group = lambda: rng.choice(["a", "a", "a", "a", "b", "c", None])
    demands = [(i, group(), rng.choice([None, *range(12)])) for i in range(200)]
    offers = [(i, group(), rng.choice([None, *range(10)]), rng.randint(0, 4)) for i in range(60)] + [(99, "z", 5, 1)]
    found = best_offer(spark.createDataFrame(demands, "d long, g string, need int"), spark.createDataFrame(offers, "id long, g string, room int, score int"), ["g"], "need", "room", F.struct("score", -F.col("id")), ["id"]).collect()
    want = []
    for d, g, need in demands:
        fit = [(score, -i) for i, h, room, score in offers if None not in (g, need, room) and h == g and room >= need]
        want += [(d, g, need, -max(fit)[1])] if fit else []
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 50


def test_set_attribute_sets_nulls_and_refuses_repeats(spark):
    import pytest

    from embergrid.operators.attributes import set_attribute

    table = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "id long, cpu int")
    new = spark.createDataFrame([(0, None), (1, 7), (9, 9)], "id long, cpu int")
    assert sorted(map(tuple, set_attribute(table, ["id"], "cpu", new).collect())) == [(0, None), (1, 7), (2, 3)]
    with pytest.raises(Exception, match="repeated key"):
        set_attribute(table, ["id"], "cpu", new.union(new)).collect()


def test_centralities_by_blocks_of_sources(spark):
    from embergrid.operators import graph as G

    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5)], "src long, dst long")
    nodes = spark.range(6)
    for f in (G.closeness_centrality, G.betweenness_centrality):
        whole, parts = (dict(map(tuple, f(nodes, links, block=b).collect())) for b in (100, 2))
        assert {k: round(v, 12) for k, v in whole.items()} == {k: round(v, 12) for k, v in parts.items()}
    assert {k: round(v * 20, 9) for k, v in whole.items()} == {0: 3.0, 1: 1.0, 2: 3.0, 3: 13.0, 4: 8.0, 5: 0.0}


def test_nps_starts_at_the_node_with_most_neighbours_and_weighs_links(spark):
    """Parallel links are one neighbour and the lightest counts, a loop is one; of 2 and 5 with four neighbours 2 is the root; 8 and 9 are not reached."""
    links = [(0, 1, 1, 1), (0, 1, 1, 1), (0, 1, 3, 1), (0, 1, 1, 1), (0, 1, 2, 1), (1, 2, 9, 2), (2, 1, 7, 2), (2, 3, 1, 5), (2, 4, 1, 6), (2, 2, 1, 0)]
    links += [(5, 1, 1, 1), (5, 4, 2, 1), (5, 6, 1, 1), (5, 7, 1, 1), (8, 9, 1, 1)]
    nodes = [(i, 1) for i in range(10)]
    frame = spark.createDataFrame(links, "src long, dst long, w long, bw long")
    args = spark.createDataFrame(nodes, "id long, cpu long"), frame, ["cpu"], ["bw"]
    place = lambda found: [r.id for r in sorted(found.collect(), key=lambda r: -r.score)]
    # distances 2: 0; 4, 3: 1; 5: 3; 1, 6, 7: 4; 0: 5
    assert place(ranking.rank_nps(*args, "w")) == [2, 4, 3, 5, 1, 6, 7, 0]
    # by hops 1, 4 and 3 (nrm 10, 7 and 5), then 0 (5), 5 (4), then 6, 7
    assert place(ranking.rank_nps(*args)) == [2, 1, 4, 3, 0, 5, 6, 7]
    assert ranking.rank_nps(args[0].where("false"), frame.where("false"), *args[2:]).collect() == []
    assert place(ranking.rank_nps(args[0], frame.where("false"), *args[2:])) == [0]
