"""Accounting of solutions, running recorder state and run summaries, as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.resources import mean_skip_nan
from ..operators.running import running
from ..operators.storage import dealt


def solution_accounts(demands: DataFrame, hops: DataFrame, node_resources: int = 1) -> DataFrame:
    """Per request revenue, cost and revenue-to-cost.

    ``demands``: (v_net_id, kind node|link, amount); ``hops``: (v_net_id, amount) for each routed hop.
    """
    d = demands.groupBy("v_net_id").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "node", F.col("amount"))), F.lit(0)).alias("node_revenue"),
        F.coalesce(F.sum(F.when(F.col("kind") == "link", F.col("amount"))), F.lit(0)).alias("link_revenue"),
    )
    h = hops.groupBy("v_net_id").agg(F.sum("amount").alias("link_cost"))
    out = d.join(h, "v_net_id", "left").withColumn("link_cost", F.coalesce("link_cost", F.lit(0)))
    out = out.withColumns({"node_demand": F.col("node_revenue") / node_resources, "link_demand": F.col("link_revenue"), "revenue": F.col("node_revenue") + F.col("link_revenue")})
    out = out.withColumns({"path_cost": F.col("link_cost") - F.col("link_revenue")})
    out = out.withColumn("cost", F.col("revenue") + F.col("path_cost"))
    return out.withColumn("r2c", F.when(F.col("cost") == 0, 0.0).otherwise(F.col("revenue") / F.col("cost")))


def full_accounts(accounts: DataFrame, solutions: DataFrame, compat: bool = False) -> DataFrame:
    """Accounts beside (v_net_id, result, lifetime): times with the lifetime, nothing earned on failure.

    ``compat`` keeps the demand total that counts the node demand twice and leaves the links out.
    """
    ok = F.col("result")
    out = accounts.join(solutions, "v_net_id")
    total = F.col("node_demand") * 2 if compat else F.col("node_demand") + F.col("link_demand")
    out = out.withColumn("v_net_demand", total)
    out = out.withColumns({c: F.when(ok, F.col(c)).otherwise(0.0) for c in ("revenue", "cost", "r2c", "path_cost")})
    return out.withColumns({f"time_{c}": F.col(c) * F.col("lifetime") for c in ("revenue", "cost")})


def partial_accounts(placed: DataFrame, routed: DataFrame, node_resources: int = 1) -> DataFrame:
    """Accounts of what is placed (v_net_id, amount) and routed (v_net_id, amount, hops) so far.

    Revenue takes the raw node sum, the node cost the sum by resource.
    """
    n = placed.groupBy("v_net_id").agg(F.sum("amount").alias("node_revenue"))
    e = routed.groupBy("v_net_id").agg(F.sum("amount").alias("link_revenue"), F.sum(F.col("amount") * F.col("hops")).alias("link_cost"))
    out = n.join(e, "v_net_id", "full").na.fill(0, ["node_revenue", "link_revenue", "link_cost"])
    out = out.withColumns({"revenue": F.col("node_revenue") + F.col("link_revenue"), "cost": F.col("node_revenue") / node_resources + F.col("link_cost")})
    return out.withColumn("r2c", F.when(F.col("cost") == 0, 0.0).otherwise(F.col("revenue") / F.col("cost")))


def running_state(records: DataFrame, run: str = "run_id") -> DataFrame:
    """Totals after every event of each run: counts, in service, revenue, cost."""
    arrival = F.col("event_type") == 1
    accepted = arrival & F.col("result")
    leave_ok = (F.col("event_type") == 0) & F.col("result")
    return running(records, [run], ["event_id"], {
        "v_net_count": arrival.cast("long"),
        "success_count": accepted.cast("long"),
        "inservice_count": accepted.cast("long") - leave_ok.cast("long"),
        "total_revenue": F.when(accepted, F.col("revenue")).otherwise(0.0),
        "total_cost": F.when(accepted, F.col("cost")).otherwise(0.0),
        "total_time_revenue": F.when(accepted, F.col("revenue") * F.col("lifetime")).otherwise(0.0),
    })


def running_membership(placements: DataFrame, run: str = "run_id") -> DataFrame:
    """Physical nodes with a live request after every event of each run.

    ``placements``: (run, event_id, p_node, step), step 1 for each node that an accepted arrival takes,
    -1 where its leave frees it. Each node's own running sum tells where it turns live or idle; the turns
    are then summed over the events. Both sums run in ranges, so neither a run nor a node is one group.
    """
    steps = dealt(placements, run, "p_node", "event_id").groupBy(run, "p_node", "event_id").agg(F.sum("step").alias("step"))
    turned = running(steps, [run, "p_node"], ["event_id"], {"held": F.col("step")})
    turned = turned.withColumn("turn", (F.col("held") > 0).cast("long") - (F.col("held") - F.col("step") > 0).cast("long"))
    events = turned.groupBy(run, "event_id").agg(F.sum("turn").alias("turn"))
    return running(events, [run], ["event_id"], {"running_nodes": F.col("turn")}).select(run, "event_id", "running_nodes")


def run_summary(state: DataFrame, run: str = "run_id") -> DataFrame:
    """One row for each run: rates from the last event, means over arrivals, extremes over all events."""
    arrival = F.col("event_type") == 1
    last = F.max_by(F.struct("v_net_count", "success_count", "total_revenue", "total_cost", "total_time_revenue", "event_time"), "event_id").alias("l")
    out = state.groupBy(run).agg(
        last,
        mean_skip_nan(F.when(arrival, F.col("r2c"))).alias("avg_r2c"),
        F.max("inservice_count").alias("max_inservice"),
        F.min("available").alias("min_available"),
        F.count_if(arrival & ~F.col("place_result")).alias("place_failures"),
        F.count_if(arrival & F.col("place_result") & ~F.col("route_result")).alias("route_failures"),
    )
    return out.select(run, (F.col("l.success_count") / F.col("l.v_net_count")).alias("acceptance_rate"), "avg_r2c", "l.v_net_count", "l.success_count", "l.total_revenue", "l.total_cost", (F.col("l.total_revenue") / F.col("l.event_time")).alias("long_term_revenue"), "max_inservice", "min_available", "place_failures", "route_failures")


def window_summary(records: DataFrame, origin: float, size: float, run: str = "run_id") -> DataFrame:
    """Tumbling windows: arrivals open windows, leaves count to the window of the arrival before them."""
    from ..functions.resources import window_index

    own = F.when(F.col("event_type") == 1, window_index(F.col("event_time"), origin, size))
    rows = running(records, [run], ["event_id"], lasts={"window": own}).where("window is not null")
    arrival = F.col("event_type") == 1
    return rows.groupBy(run, "window").agg(F.min("event_time").alias("first_event_time"), F.max("event_time").alias("last_event_time"), F.count_if(arrival).alias("arrival_steps"), F.count_if(arrival & F.col("result")).alias("accepted"), F.count_if(arrival & ~F.col("result")).alias("rejected"), F.count_if(~arrival).alias("auto_released_events"))


def in_service(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests active after each event: +1 at arrivals, -1 at leaves, summed in time order over ranges of time."""
    plus = requests.select(*(by or []), F.col("arrival_time").alias("time"), F.lit(1).alias("step"))
    minus = requests.select(*(by or []), (F.col("arrival_time") + F.col("lifetime")).alias("time"), F.lit(-1).alias("step"))
    steps = plus.unionAll(minus).groupBy(*(by or []), "time").agg(F.sum("step").alias("step"))
    return running(steps, by or [], ["time"], {"active": F.col("step")})


def concatenate_stages(runs: list[DataFrame], offsets: list[int]) -> DataFrame:
    """Runs of all stages with epochs counted on."""
    out = None
    for stage, (run, first) in enumerate(zip(runs, offsets)):
        part = run.withColumns({"stage": F.lit(stage), "epoch": F.col("epoch") + first})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
