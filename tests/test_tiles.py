"""Products in tiles against plain numpy, and that a round moves blocks instead of arcs."""

import numpy as np

from embergrid.operators import ranking, tiles


def test_rankings_over_many_blocks_move_no_arcs(spark, monkeypatch):
    monkeypatch.setattr(tiles, "LEAST", 3)
    monkeypatch.setattr(tiles, "MOST", 3)
    plans, saved = [], tiles.saved
    monkeypatch.setattr(tiles, "saved", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), saved(df))[1])
    # a hub, a link given in both directions, a loop, a node alone, an end that is no node
    links = [(0, k, k) for k in range(1, 9)] + [(3, 0, 2), (4, 4, 5), (5, 6, 1), (2, 99, 7)]
    m = np.zeros((10, 10))
    for u, v, _ in links[:-1]:
        m[u, v] = m[v, u] = 1.0
    c = np.array([10.0 + 3 * i for i in range(10)])
    w = np.zeros(10)
    for u, v, k in links:
        for end in {u, v} - {99}:
            w[end] += k
    b = (c * w + 1e-9) / (c * w + 1e-9).sum()
    held, want = m @ c, b
    for _ in range(2):
        want = 0.15 * b + 0.85 * c * (m @ np.divide(want, held, out=np.zeros(10), where=held > 0))
    nodes = spark.createDataFrame([(i, float(x)) for i, x in enumerate(c)], "id long, cpu double")
    got = {r["id"]: r["score"] for r in ranking.rank_rw(nodes, spark.createDataFrame(links, "src long, dst long, bw long"), ["cpu"], "bw", tolerance=0.0, rounds=2).collect()}
    assert np.allclose([got[i] for i in range(10)], want, atol=1e-12)
    rounds = [p for p in plans if "cogroup" in p.lower()]
    assert len(rounds) == 3
    # the vector's blocks are dealt to the tiles, and the tiles stay
    assert all(p.count("hashpartitioning(i#") == 1 for p in rounds)
    assert not any(t.name.startswith("embergrid_") for t in spark.catalog.listTables())
