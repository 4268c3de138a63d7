import pytest

from embergrid.operators.embedding import Request, Substrate, transaction
from embergrid.plans import accounting, reporting, simulate, systems


@pytest.fixture
def network():
    return Substrate({i: {"cpu": 20} for i in range(4)}, {(0, 1): {"bw": 10}, (1, 2): {"bw": 10}, (2, 3): {"bw": 10}, (0, 3): {"bw": 10}})


@pytest.fixture
def nested(spark):
    requests = spark.createDataFrame([(0, 0.0, 5.0), (1, 1.0, 5.0), (2, 2.0, 9.0), (3, 20.0, 1.0)], "v_net_id long, arrival_time double, lifetime double")
    nodes = spark.createDataFrame([(i, k, 15) for i in range(4) for k in range(2)], "v_net_id long, id long, cpu long")
    links = spark.createDataFrame([(i, 0, 1, 4) for i in range(4)], "v_net_id long, src long, dst long, bw long")
    return simulate.nested_requests(requests, nodes, links, ["cpu"], ["bw"])


def test_online(spark, network, nested):
    state, summary = systems.online(spark, network, nested, ["ffd_rank", "nrm_rank"], ["cpu"], ["bw"])
    rows = [r for r in state.where("run_id = 0").orderBy("event_id").collect()]
    assert [r["event_type"] for r in rows] == [1, 1, 1, 0, 0, 0, 1, 0]
    assert [r["inservice_count"] for r in rows] == [1, 2, 2, 1, 0, 0, 1, 0]
    got = {r["run_id"]: r for r in summary.collect()}
    assert got[0]["acceptance_rate"] == got[1]["acceptance_rate"] == 0.75 and got[0]["place_failures"] == 1 and got[0]["total_revenue"] == 3 * 34
    assert got[0]["max_inservice"] == 2 and got[0]["min_available"] == 20.0


def test_other_modes(spark, network, nested):
    assert systems.offline(spark, network, nested, "mip", ["cpu"], ["bw"]).first()["acceptance_rate"] == 1.0
    windows = {r["window"]: r for r in systems.time_window(spark, network, nested, "ffd_rank", ["cpu"], ["bw"], 10.0).collect()}
    assert (windows[0]["arrival_steps"], windows[0]["accepted"], windows[0]["rejected"], windows[0]["auto_released_events"]) == (3, 2, 1, 3) and windows[2]["arrival_steps"] == 1
    stages = systems.changeable(spark, [(network, nested), (network, nested)], "ffd_rank", ["cpu"], ["bw"])
    assert {(r["stage"], r["epoch"]) for r in stages.select("stage", "epoch").distinct().collect()} == {(0, 0), (1, 1)}
    assert systems.mode_of({"offline": True, "changeable": True}) == "changeable" and systems.mode_of({}) == "online"


def test_accounts(spark):
    demands = spark.createDataFrame([(1, "node", 6.0), (1, "link", 4.0), (2, "node", 2.0)], "v_net_id long, kind string, amount double")
    hops = spark.createDataFrame([(1, 4.0), (1, 4.0)], "v_net_id long, amount double")
    accounts = accounting.solution_accounts(demands, hops)
    solutions = spark.createDataFrame([(1, True, 2.0), (2, False, 3.0)], "v_net_id long, result boolean, lifetime double")
    rows = {r["v_net_id"]: r for r in accounting.full_accounts(accounts, solutions).collect()}
    assert (rows[1]["revenue"], rows[1]["cost"], rows[1]["time_cost"], rows[1]["v_net_demand"]) == (10.0, 14.0, 28.0, 10.0) and rows[2]["revenue"] == 0.0
    assert {r["v_net_demand"] for r in accounting.full_accounts(accounts, solutions, compat=True).collect()} == {12.0, 4.0}
    part = accounting.partial_accounts(demands.where("kind = 'node'"), spark.createDataFrame([(1, 4.0, 2)], "v_net_id long, amount double, hops int"), 2)
    assert {r["v_net_id"]: (r["revenue"], r["cost"]) for r in part.collect()} == {1: (10.0, 11.0), 2: (2.0, 1.0)}


def test_reporting(spark, tmp_path, network):
    df = spark.createDataFrame([(1, {1: 2})], "id long, slots map<long,long>")
    assert reporting.flat_records(df).first()["slots"] == '{"1":2}'
    reporting.save_records(df, str(tmp_path / "r"))
    assert reporting.load_records(spark, str(tmp_path / "r")).count() == 1
    assert reporting.file_name("p", [("n", 3), ("a", 0.5), ("x", [1, 2])], 4, ".csv") == "p-n_3-a_0.5-x_1-2-epoch_4.csv"
    reporting.clean_run_folder(str(tmp_path / "r"), str(tmp_path))
    with pytest.raises(ValueError):
        reporting.clean_run_folder(str(tmp_path), str(tmp_path))
    seen, frames = [], []
    log = reporting.MetricLog(interval=2)
    log.attach(lambda step, m: seen.append((step, m)))
    for i in range(4):
        log.log({"i": i})
    bar = reporting.Progress(10, frames.append, every=1e9)
    bar.update(5), bar.update(10)
    assert [s for s, _ in seen] == [2, 4] and frames[-1] == "10/10 (100 %)"
    before = network.copy()
    with pytest.raises(RuntimeError), transaction(network):
        network.change_node(0, {"cpu": 3}, -1)
        raise RuntimeError
    assert network.nodes == before.nodes and Request(1, {0: {"cpu": 1}}, {}).revenue == 1
