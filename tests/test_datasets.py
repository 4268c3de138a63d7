"""Datasets, XML topologies, parallel commits, running totals and leases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from embergrid.operators.commits import commit_updates
from embergrid.operators.running import running
from embergrid.sources import datasets, files, topologies
from embergrid.streaming import leases


def networks(spark, n):
    nodes = spark.createDataFrame([(f"g{i}", k, float(k) / 3, None if k % 2 else f'a&"{k}é') for i in range(n) for k in range(i + 1)], "network string, id long, cpu double, label string")
    links = spark.createDataFrame([(f"g{i}", k, k, k + 1, k * 10) for i in range(n) for k in range(i)], "network string, eid long, src long, dst long, bw long")
    return nodes, links


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_networks_round_trip(spark, tmp_path):
    nodes, links = networks(spark, 7)
    path = f"{tmp_path}/nets"
    datasets.write_networks(nodes, links, path)
    assert sorted(os.listdir(path)) == [f"g{i}.gml" for i in range(7)]
    n, e = datasets.read_networks(spark, path, {"cpu": "double", "label": "string"}, {"bw": "long"})
    assert rows(n) == rows(nodes) and rows(e) == rows(links)
    one, _ = datasets.read_networks(spark, f"file:{path}/g3.gml", {"cpu": "double"}, {})
    assert rows(one) == rows(nodes.where("network = 'g3'").drop("label"))
    with pytest.raises(Exception, match="there already"):
        datasets.write_networks(nodes, links, path)
    datasets.write_networks(nodes.where("network = 'g1'"), links.where("network = 'g1'"), path, mode="overwrite")
    assert os.listdir(path) == ["g1.gml"]
    with pytest.raises(FileNotFoundError):
        datasets.read_networks(spark, f"{tmp_path}/none", {}, {})


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    nodes, links = networks(spark, 9)
    bad = links.withColumn("bw", F.when(F.col("network") == "g8", F.raise_error(F.lit("no capacity")).cast("long")).otherwise(F.col("bw")))
    with pytest.raises(Exception, match="no capacity"):
        datasets.write_networks(nodes, bad, f"{tmp_path}/nets")
    assert not [f for _, _, names in os.walk(f"{tmp_path}/nets") for f in names]


def test_requests_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(v, k, 5 + k) for v in (0, 1, 100_000) for k in range(3)], "v_net_id long, id long, cpu long")
    links = spark.createDataFrame([(v, k, k, k + 1, 2) for v in (0, 1, 100_000) for k in range(2)], "v_net_id long, eid long, src long, dst long, bw long")
    events = [(0, 1, 0, 0.5), (1, 1, 1, 0.5), (2, 0, 0, 1.25), (3, 1, 100_000, 2.0), (4, 0, 1, 3.0), (5, 0, 100_000, 3.0)]
    frame = lambda e: spark.createDataFrame(e, "id long, type int, v_net_id long, time double")
    datasets.save_requests(nodes, links, frame(events), f"{tmp_path}/d")
    assert sorted(os.listdir(f"{tmp_path}/d/v_nets")) == ["v_net-00000.gml", "v_net-00001.gml", "v_net-100000.gml"]
    n, e, ev = datasets.load_requests(spark, f"{tmp_path}/d", {"cpu": "long"}, {"bw": "long"})
    assert rows(n) == rows(nodes) and rows(e) == rows(links) and rows(ev) == sorted(events)
    known = spark.createDataFrame([(0,), (1,), (100_000,)], "v_net_id long")
    datasets.check_events(frame([]), known.where("false"))
    for bad in (events[1:], events[:-1], [*events[:5], (5, 0, 100_000, 2.5)], [*events[:5], (5, 0, 100_000, float("inf"))], [*events[:5], (5, 1, 100_000, 3.0)], [*events[:5], (5, 0, 7, 3.0)], [(0, 0, 0, 0.1), (1, 1, 0, 0.2), *events[2:]]):
        with pytest.raises(ValueError):
            datasets.check_events(frame(bad), known)
    with pytest.raises(FileNotFoundError):
        datasets.load_requests(spark, str(tmp_path), {}, {})


XML = '<network xmlns="http://s"><nodes>{nodes}</nodes><links><link id="L"><source>Ä2</source><target>Z1</target><preInstalledModule><capacity>5</capacity><cost>9</cost></preInstalledModule></link></links></network>'
NODES = "".join(f'<node id="{n}"><coordinates><x>{i}</x><y>2.5</y></coordinates></node>' for i, n in enumerate(("Z1", "Ä2", "A3")))


@pytest.mark.parametrize("encoding, mark, declared", [("utf-8", b"", None), ("utf-8", b"\xef\xbb\xbf", "UTF-8"), ("utf-16-le", b"\xff\xfe", None), ("utf-16-be", b"\xfe\xff", "UTF-16"), ("utf-16-le", b"", "utf-16"), ("utf-16-be", b"", None), ("latin-1", b"", "ISO-8859-1"), ("utf-32-le", b"", None)])
def test_xml_encodings(spark, tmp_path, encoding, mark, declared):
    head = f'<?xml version="1.0" encoding="{declared}"?>' if declared else ""
    (tmp_path / "t.xml").write_bytes(mark + (head + XML.format(nodes=NODES)).encode(encoding))
    nodes, links = topologies.read_sndlib(spark, str(tmp_path))
    assert rows(nodes) == [("t", 0, "Z1", 0.0, 2.5), ("t", 1, "Ä2", 1.0, 2.5), ("t", 2, "A3", 2.0, 2.5)]
    assert rows(links) == [("t", 0, "L", 1, 0, 5.0, 5.0)]


def test_bad_xml_names_file_and_offset():
    text = XML.format(nodes=NODES).encode()
    at = text.index("Ä".encode())
    for raw, said in (
        (text[: at + 1] + b"\xff" + text[at + 2 :], f"f.xml: bad byte at offset {at}"),
        (b"\xff\xfe" + "<a>".encode("utf-16-le") + b"\x00\xd8" + "</a>".encode("utf-16-le"), "f.xml: bad byte at offset 8"),
        (text[:at] + b"a" * 70_000 + b"\xff" + text[at:], f"f.xml: bad byte at offset {at + 70_000}"),
        (b'<?xml version="1.0" encoding="klingon"?><a/>', "unknown encoding"),
        (b'<?xml version="1.0" encoding="UTF-16"?><a/>', "declared as UTF-16"),
        (text[:-3], "f.xml: "),
        (text.replace(b"Z1</target>", b"Q</target>"), "unknown link end 'Q'"),
        (text.replace(b"A3", b"Z1"), "repeated"),
        (text.replace(b"2.5", b"zwei"), "no number"),
        (b"", "f.xml: "),
    ):
        with pytest.raises(ValueError, match=said):
            topologies.parse_topology(raw, "f.xml")


def test_topologies_to_networks(spark, tmp_path):
    """Many files at once, written on as GML."""
    os.mkdir(tmp_path / "x")
    for name in ("one", "two"):
        (tmp_path / "x" / f"{name}.xml").write_text(XML.format(nodes=NODES))
    nodes, links = topologies.read_sndlib(spark, str(tmp_path / "x"), copy_capacity_as_cost=False)
    datasets.write_networks(nodes, links.withColumnRenamed("id", "eid").drop("label"), f"{tmp_path}/g")
    n, e = datasets.read_networks(spark, f"{tmp_path}/g", {"label": "string", "x": "double", "y": "double"}, {"capacity": "double", "cost": "double"})
    assert rows(n) == rows(nodes) and rows(e) == [("one", 0, 1, 0, 5.0, 9.0), ("two", 0, 1, 0, 5.0, 9.0)]
    assert files.load_gml((tmp_path / "g" / "one.gml").read_text())["nodes"][1]["label"] == "Ä2"


def one_by_one(updates, capacity, order):
    left, out = dict(capacity), {}
    for txn in sorted({t for t, *_ in updates}, key=order):
        own = {}
        for t, target, amount in updates:
            if t == txn:
                own[target] = own.get(target, 0) + amount
        out[txn] = all(left.get(k, 0) >= a for k, a in own.items())
        if out[txn]:
            left.update({k: left.get(k, 0) - a for k, a in own.items()})
    return out, left


@pytest.mark.parametrize("seed", range(2))
def test_commits_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    updates = [(t, rng.choice([0, 0, 0, *range(1, 6)]), rng.randint(0, 9)) for t in range(120) for _ in range(rng.randint(1, 3))]
    capacity = [(k, rng.randint(0, 120)) for k in range(5)]
    frame = spark.createDataFrame(updates, "txn long, target long, amount long").withColumn("p", F.col("txn") * 37 % 101)
    decided, left = commit_updates(frame, spark.createDataFrame(capacity, "target long, left long"), "p", ranges=5)
    want, rest = one_by_one(updates, capacity, lambda t: (t * 37 % 101, t))
    got = {r.txn: r for r in decided.collect()}
    assert {t: r.committed for t, r in got.items()} == want
    assert {r.target: r.left for r in left.collect()} == {**rest, **{k: 0 for _, k, _ in updates if k not in rest}}
    assert max(r.round for r in got.values()) < 40
    hashed = {r.txn: r.committed for r in commit_updates(frame.drop("p"), spark.createDataFrame(capacity, "target long, left long"))[0].collect()}
    order = {r[0]: r[1] for r in frame.select("txn", F.xxhash64("txn")).distinct().collect()}
    assert hashed == one_by_one(updates, capacity, lambda t: (order[t], t))[0]


def test_running_totals(spark):
    rng = random.Random(4)
    data = [(rng.choice([None, "a", "a", "a", "b"]), i, rng.choice([None, 1, 2, 5])) for i in range(500)]
    frame = spark.createDataFrame(data, "k string, i long, v int")
    got = sorted(map(tuple, running(frame, ["k"], ["i"], {"s": F.col("v"), "n": F.lit(1)}, {"l": F.when(F.col("v") > 1, F.col("i"))}, ranges=11).collect()), key=lambda r: r[1])
    sums, counts, lasts = {}, {}, {}
    for k, i, v in data:
        if v is not None:
            sums[k] = sums.get(k, 0) + v
            if v > 1:
                lasts[k] = i
        counts[k] = counts.get(k, 0) + 1
        assert got[i] == (k, i, v, sums.get(k), counts[k], lasts.get(k))
    assert running(frame.where("false"), [], ["i"], {"s": F.col("v")}).collect() == []


def arrivals(n, seed):
    rng = random.Random(seed)
    return [(f"n{rng.randint(0, 2)}", i, 1_700_000_000 + rng.randint(0, 3000), float(rng.randint(1, 400)), float(rng.randint(1, 9))) for i in range(n)]


def by_hand(events, capacity):
    out = []
    for network in {e[0] for e in events}:
        left, active = capacity, []
        for _, i, t, life, demand in sorted((e for e in events if e[0] == network), key=lambda e: (e[2], e[1])):
            left += sum(d for end, d in active if end < t)
            active = [x for x in active if x[0] >= t]
            if demand <= left:
                left -= demand
                active.append((t + life, demand))
                out.append((network, i, t * 1_000_000, True, left))
            else:
                out.append((network, i, t * 1_000_000, False, left))
    return sorted(out, key=repr)


SCHEMA = "network string, v_net_id long, at long, lifetime double, demand double"


def test_leases_in_batch(spark):
    events = arrivals(200, 0)
    frame = spark.createDataFrame(events + events[:5], SCHEMA).withColumn("ts", F.timestamp_seconds("at"))
    assert rows(leases.admissions(frame, 20.0)) == by_hand(events, 20.0)
    assert {r[3] for r in by_hand(events, 20.0)} == {True, False}


def test_leases_in_a_stream(spark, tmp_path):
    """Shuffled input gives the admissions of the batch form; what is behind the watermark is left out."""
    events = sorted(arrivals(150, 1), key=lambda e: e[2])
    rng = random.Random(5)
    files_of = [events[i : i + 50] for i in range(0, 150, 50)]
    for k, part in enumerate(files_of):
        part = [*part, ("n0", 9000 + k, part[-1][2], 1.0, 0.0)]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    late = ("n0", 7777, events[0][2] - 5000, 1.0, 9.0)
    end = ("n1", 8888, events[-1][2] + 100_000, 1.0, 0.0)
    spark.createDataFrame([late, end], SCHEMA).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/0").schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    with pytest.raises(ValueError):
        leases.capacity_stream(source, 20.0, "10 minutes")
    spark.conf.set(key, leases.ROCKSDB)
    try:
        query = leases.capacity_stream(source, 20.0, "10 minutes").writeStream.format("memory").queryName("admitted").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
    finally:
        spark.conf.set(key, before)
    got = rows(spark.table("admitted"))
    every = events + [("n0", 9000 + k, part[-1][2], 1.0, 0.0) for k, part in enumerate(files_of)]
    assert got == by_hand(every, 20.0)


def test_small_files_share_a_partition(spark, tmp_path, monkeypatch):
    nodes = spark.range(300).select(F.concat(F.lit("n"), "id").alias("network"), F.lit(0).alias("id"), F.col("id").alias("cpu"))
    links = spark.createDataFrame([], "network string, src long, dst long")
    datasets.write_networks(nodes, links, f"{tmp_path}/many")
    found = datasets.read_networks(spark, f"{tmp_path}/many", {"cpu": "long"}, {})[0]
    assert found.rdd.getNumPartitions() == 1
    assert sorted((r.network, r.id, r.cpu) for r in found.collect()) == sorted((f"n{i}", 0, i) for i in range(300))
    assert [p.value for p in files._in_parts([("a", 5 << 20), ("b", 5 << 20), ("c", 20 << 20), ("d", 1), ("e", 1)])] == [["a"], ["b"], ["c"], ["d", "e"]]
    monkeypatch.setattr(files, "PART_FILES", 2)
    assert [p.value for p in files._in_parts([(c, 1) for c in "abcde"])] == [["a", "b"], ["c", "d"], ["e"]]
