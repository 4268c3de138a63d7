import json
import random

import pytest
from pyspark.sql import functions as F

from embergrid.functions import resources as R
from embergrid.operators import attributes as P
from embergrid.sources import config, files, generators, topologies


def test_csv(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write('﻿a,b\r\n" 1 ","x, ""y""\nz"\r\n2,\r\n')
    rows = files.typed(files.read_csv(spark, path), {"a": "long"}).collect()
    assert [tuple(r) for r in rows] == [(1, 'x, "y"\nz'), (2, None)]
    assert files.typed(spark.createDataFrame([("x",)], "a string"), {"a": "long"}, strict=False).first()[0] is None
    files.write_csv_file([{"a": 1}], str(tmp_path / "b.csv"))
    files.write_csv_file([{"a": 2}], str(tmp_path / "b.csv"), append=True)
    assert (tmp_path / "b.csv").read_bytes() == b"a\r\n1\r\n2\r\n"
    with pytest.raises(ValueError):
        files.write_csv_file([{"b": 2}], str(tmp_path / "b.csv"), append=True)
    with pytest.raises(ValueError):
        files.validate_columns(["a", "a"])


GML = 'graph [ name "G &amp; co" tags "_networkx_list_start" tags 7 node [ id 0 label "a" pos [ x 1.5 ] ] node [ id 1 ] edge [ source 0 target 1 bw 3 ] ]'


def test_gml(spark, tmp_path):
    network = files.load_gml(GML)
    assert network["graph"] == {"name": "G & co", "tags": [7]} and network["nodes"][0]["pos"] == {"x": 1.5} and network["links"] == [{"source": 0, "target": 1, "bw": 3}]
    assert files.load_gml(files.dump_gml(network)) == network
    for bad in ("graph [ node [ id 0 ] node [ id 0 ] ]", "graph [ edge [ source 0 target 1 ] ]", "graph [ node [ id 0 ]", "graph [ multigraph 1 ]"):
        with pytest.raises(ValueError):
            files.load_gml(bad)
    (tmp_path / "g.gml").write_text(GML)
    files.register_gml(spark)
    assert spark.read.format("gml").option("kind", "links").load(str(tmp_path)).select("src", "dst").collect() == [(0, 1)]


def test_sndlib(spark, tmp_path):
    path = tmp_path / "t.xml"
    path.write_text('<network><nodes><node id="B"><coordinates><x>1</x><y>2</y></coordinates></node><node id="A"><coordinates><x>3</x><y>4</y></coordinates></node></nodes><links><link id="L"><source>A</source><target>B</target><preInstalledModule><capacity>5</capacity><cost>9</cost></preInstalledModule></link></links></network>')
    nodes, links = topologies.read_sndlib(spark, str(path))
    assert [tuple(r) for r in nodes.select("id", "label").orderBy("id").collect()] == [(0, "B"), (1, "A")]  # file order
    assert [tuple(r) for r in links.select("src", "dst", "capacity", "cost").collect()] == [(1, 0, 5.0, 5.0)]
    assert topologies.read_sndlib(spark, str(path), copy_capacity_as_cost=False)[1].first()["cost"] == 9.0


def test_config(tmp_path):
    (tmp_path / "net").mkdir()
    (tmp_path / "net/a.yaml").write_text("size: 3\nname: ${top}-${.size}\n")
    (tmp_path / "net/b.yaml").write_text("size: 4\n")
    (tmp_path / "main.yaml").write_text("defaults:\n  - net: a\n  - optional none: x\n  - _self_\ntop: t\nnet:\n  extra: [1, '${top}']\n")
    c = config.load_config(str(tmp_path / "main.yaml"), ["top=u", "+new.k=1"])
    assert c.get("net") == {"size": 3, "name": "u-3", "extra": [1, "u"]} and c.get("new.k") == 1 and c.get("no", 5) == 5
    assert config.load_config(str(tmp_path / "main.yaml"), ["net=b"]).get("net.size") == 4
    with pytest.raises(KeyError):
        c.override("missing=1")
    for suffix in ("json", "yaml"):
        files.write_setting({"a": [1, 2**80]}, str(tmp_path / f"s.{suffix}"))
        assert files.read_setting(str(tmp_path / f"s.{suffix}")) == {"a": [1, 2**80]}


def test_generators(spark):
    def pairs(df):
        return sorted(map(tuple, df.select("src", "dst").collect()))

    assert pairs(generators.path_links(spark, 3)) == [(0, 1), (1, 2)] and pairs(generators.star_links(spark, 2)) == [(0, 1), (0, 2)]
    assert pairs(generators.grid_links(spark, 2, 3)) == sorted(generators.topology("grid_2d", 6, random.Random(0), m=2, n=3))
    assert len(pairs(generators.grid_links(spark, 3, 3, True))) == 18
    links = generators.topology("waxman", 20, random.Random(1))
    assert links == generators.topology("waxman", 20, random.Random(1)) and generators.is_connected(20, links)
    requests, nodes, _ = generators.virtual_requests(spark, 5, 2)
    events = generators.event_schedule(requests).orderBy("id").collect()
    assert [e["id"] for e in events] == list(range(10)) and [e["time"] for e in events] == sorted(e["time"] for e in events) and nodes.count() >= 10


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 5.0), (9.0, 1.0)], "a double, b double")
    row = df.agg(R.mean_skip_nan(F.col("a")).alias("m"), R.min_skip_nan(F.col("a")).alias("n")).first()
    assert tuple(row) == (5.0, 1.0)
    assert [r[0] for r in df.select(R.subtract(F.col("b"), F.lit(1.0))).collect()] == [1.0, 4.0, 0.0]
    with pytest.raises(Exception, match="bw: "):
        df.select(R.subtract(F.col("b"), F.lit(3.0), "bw")).collect()
    with pytest.raises(ValueError):
        R.satisfied(F.col("a"), F.col("b"), "==")
    paths = spark.createDataFrame([(1, [3, 4, 5])], "path_id long, path array<long>")
    assert [tuple(r) for r in P.path_to_links(paths).orderBy("hop").collect()] == [(1, 0, 3, 4), (1, 1, 4, 5)]


def test_admission_stream(spark, tmp_path):
    from embergrid.streaming.events import admission_stream, windowed_counts

    schema = "network long, v_net_id long, time double, lifetime double, demand double"
    spark.createDataFrame([(1, 1, 0.0, 5.0, 6.0), (1, 2, 1.0, 5.0, 6.0), (1, 3, 7.0, 1.0, 6.0), (2, 4, 0.0, 1.0, 6.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = admission_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 10.0).writeStream.format("memory").queryName("adm").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["v_net_id"], r["accepted"]) for r in spark.table("adm").collect()) == [(1, True), (2, False), (3, True), (4, True)]
    batch = spark.sql("select timestamp'2024-01-01 00:00:10' ts, 'a' event_type union all select timestamp'2024-01-01 00:01:10', 'a'")
    assert windowed_counts(batch, "1 minute", "1 minute").count() == 2


def test_gml_keeps_keys_and_signs_of_infinity():
    from embergrid.sources import files

    network = {"directed": False, "graph": {"info": 3, "nanos": 1.5}, "nodes": [{"id": 0, "low": float("-inf"), "high": float("inf"), "bad": float("nan")}], "links": []}
    text = files.dump_gml(network)
    assert "info 3" in text and "nanos 1.5" in text and "low -INF" in text and "high +INF" in text and "bad NAN" in text
    again = files.load_gml(text)
    assert again["graph"] == {"info": 3, "nanos": 1.5} and again["nodes"][0]["low"] == float("-inf") and again["nodes"][0]["bad"] != again["nodes"][0]["bad"]


def test_reports_never_cut_rows(spark, monkeypatch):
    from embergrid.plans import reporting

    monkeypatch.setattr(reporting, "MAX_ROWS", 3)
    assert len(json.loads(reporting.run_report(spark.range(3)))["summary"]) == 3
    with pytest.raises(ValueError):
        reporting.run_report(spark.range(4))


def test_links_change_by_tables(spark):
    from embergrid.operators import attributes as P

    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    links = spark.createDataFrame([(0, 0, 1, 5), (1, 1, 2, 6)], "eid long, src long, dst long, bw long")
    new = spark.createDataFrame([(3, 2, 7), (2, 1, 9), (2, 3, 8)], "src long, dst long, bw long").coalesce(1)
    added = {(r["eid"], r["src"], r["dst"]) for r in P.add_edges(links, new).collect()}
    assert added == {(0, 0, 1), (1, 1, 2), (2, 2, 3)}
    assert [tuple(r) for r in P.remove_edges(links, new).collect()] == [(0, 0, 1, 5)]
    assert sorted(r["eid"] for r in P.add_edges(links.limit(1), new.limit(1)).collect()) == [0, 1]
    assert [r["eid"] for r in P.add_edges(links.where("eid = 9"), new.limit(1)).collect()] == [0]
    kept, left = P.remove_nodes(nodes, links, nodes.where("id = 2"))
    assert kept.count() == 3 and [r["eid"] for r in left.collect()] == [0]
    assert P.add_nodes(nodes, spark.createDataFrame([(3,), (9,)], "id long")).count() == 5
    assert P.has_edge(links, 2, 1) and not P.has_edge(links, 2, 1, directed=True) and P.endpoints(links, 1) == (1, 2)
    with pytest.raises(KeyError):
        P.edge_by_id(links, 7)


def test_gml_rows_come_before_the_text_is_read_to_its_end():
    """A large file's entries are not held: rows come one at a time, and what is wrong at the end is found at the end."""
    rows = files.gml_rows('graph [ node [ id 1 ] node [ id 2 cpu 3 ] edge [ source 1 target 2 ] edge [ source 2 target 1 ] ]', "nodes")
    assert next(rows) == {"id": 1} and next(rows) == {"id": 2, "cpu": 3}
    with pytest.raises(ValueError, match="duplicate link"):
        next(rows)
