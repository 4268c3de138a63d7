"""Tasks stay as large as they are when tables grow: large groupings are dealt over partitions by their rows."""

from embergrid import catalog
from embergrid.operators import storage
from embergrid.operators.aggregates import sparse_matrix
from embergrid.operators.graph import arcs_of


def test_partitions_grow_with_the_links(spark, monkeypatch):
    monkeypatch.setattr(storage, "PART_ROWS", 50)
    links = spark.createDataFrame([(i, 1000 + i * k % 97, float(k)) for i in range(100) for k in range(1, 6)], "src long, dst long, w double")
    for found in (arcs_of(links), arcs_of(links, weight="w"), sparse_matrix(links), sparse_matrix(links, "w", normalised=True)):
        assert found.rdd.getNumPartitions() == 20
        assert found.count() == 2 * links.select("src", "dst").distinct().count()


def test_nodes_come_from_the_lines(spark, tmp_path):
    """No grouping by link, of which there are many, for the nodes, of which there are few."""
    spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, 8)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    nodes = catalog.network_nodes(spark, str(tmp_path))
    assert sorted(r.id for r in nodes.collect()) == [1, 2, catalog.PART0 + 7, catalog.PART0 + 8]
    assert "dst" not in nodes._jdf.queryExecution().optimizedPlan().toString()


def test_components_deal_the_links_by_their_rows(spark, monkeypatch):
    from embergrid.operators import graph

    monkeypatch.setattr(storage, "PART_ROWS", 50)
    seen, saved = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df: (seen.append(df.rdd.getNumPartitions()), saved(df))[1])
    links = spark.createDataFrame([(i, i + 1) for i in range(500) if i % 100 != 99], "src long, dst long")
    found = graph.connected_components(spark.range(501), links)
    assert seen[0] == 10
    assert all(r["component"] == r["id"] // 100 * 100 for r in found.collect())
