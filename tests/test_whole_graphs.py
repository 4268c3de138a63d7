"""Queries on tables whose graphs are deeper than those of the driver."""

import pytest

from embergrid import catalog


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """A path of 41 nodes by lines of quantity 50: suppliers 1 to 21, parts 1 to 20 between them."""
    d = str(tmp_path_factory.mktemp("chain"))
    lines = [(i, s, i, 1, 50.0) for i in range(1, 21) for s in (i, i + 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return d


def test_bfs_reaches_the_end_of_a_long_path(spark, chain):
    got = {r["id"]: r["distance"] for r in catalog.QUERIES["bfs"](spark, chain).collect()}
    assert got == {s: 2 * (s - 1) for s in range(1, 22)} | {catalog.PART0 + p: 2 * p - 1 for p in range(1, 21)}


def test_bfs_stats_counts_all_reached(spark, chain):
    assert tuple(catalog.QUERIES["bfs_stats"](spark, chain).first()) == (sum(range(41)), 41)


def test_nation_centralities_take_all_lines(spark, tmp_path):
    """Nations 0 - 1 - 3: lines of quantity 1 and line number 2, and sums that 3 does not divide."""
    d = str(tmp_path)
    for name, rows, schema in (
        ("lineitem", [(1, 1, 2, 1.0), (2, 3, 2, 1.0)], "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double"),
        ("orders", [(1, 1), (2, 1)], "o_orderkey long, o_custkey long"),
        ("customer", [(1, 1)], "c_custkey long, c_nationkey int"),
        ("supplier", [(1, 0), (3, 3)], "s_suppkey long, s_nationkey int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    got = {r["id"]: r["score"] for r in catalog.QUERIES["betweenness_centrality"](spark, d).collect()}
    assert got == {0: 0.0, 1: 1.0, 3: 0.0}
    got = {r["id"]: r["score"] for r in catalog.QUERIES["eigenvector_centrality"](spark, d).collect()}
    assert abs(got[0] - 0.5) < 1e-4 and abs(got[1] - 0.5**0.5) < 1e-4 and abs(got[3] - 0.5) < 1e-4


NPS = f"""WITH RECURSIVE {catalog.LINKS_SQL}, o AS (SELECT src AS id FROM a GROUP BY src ORDER BY count(DISTINCT dst) DESC, src LIMIT 1),
b(id, d) USING KEY (id) AS (SELECT id, 0::BIGINT FROM o UNION SELECT a.dst, min(b.d + a.w) FROM b JOIN a ON a.src = b.id LEFT JOIN recurring.b r ON r.id = a.dst WHERE r.id IS NULL OR b.d + a.w < r.d GROUP BY a.dst),
k AS (SELECT src AS id, (src % 50 + 50) * sum(bw)::DOUBLE AS k FROM a GROUP BY src) SELECT id, (1 - row_number() OVER (ORDER BY d, k DESC, id))::DOUBLE AS score FROM b JOIN k USING (id)"""


def test_nps_ranks_by_weight_from_the_node_with_most_neighbours(spark, tmp_path):
    """Supplier 2 has most parts; part 3 is further from it by hops and nearer by weight than part 4."""
    import duckdb

    d = str(tmp_path)
    lines = [(1, 1, 1, 1), (2, 2, 1, 1), (3, 2, 2, 1), (4, 2, 4, 7), (5, 3, 2, 2), (6, 3, 3, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    got = {r["id"]: r["score"] for r in catalog.QUERIES["rank_nps"](spark, d).collect()}
    want = duckdb.sql(NPS.replace("FROM lineitem", f"FROM '{d}/lineitem.parquet/*.parquet'")).fetchall()
    assert got == dict(want) and got[2] == 0.0 and got[catalog.PART0 + 3] > got[catalog.PART0 + 4]
