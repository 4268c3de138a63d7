"""Structured Streaming forms: windowed acceptance counts and a stateful capacity store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, size: str, late: str, time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Event counts by tumbling window; events later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).count().select(F.col("window.start").alias("start"), kind, "count")


def sliding_counts(events: DataFrame, size: str, slide: str, late: str, time: str = "ts") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size, slide)).count().select(F.col("window.start").alias("start"), "count")


def session_counts(events: DataFrame, gap: str, late: str, key: str = "user_id", time: str = "ts") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).count().select(key, F.col("w.start").alias("start"), "count")


ADMITTED = "network long, v_net_id long, time double, accepted boolean, available double"


def admission_stream(events: DataFrame, capacity: float) -> DataFrame:
    """Arrivals (network, v_net_id, time, lifetime, demand) against one capacity a network.

    The state holds the capacity left and the demands in service with their leave times; they are
    released when an arrival's time passes them.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, leaves = state.get if state.exists else (capacity, [])
        active = [tuple(x) for x in leaves]
        rows = pd.concat(list(batches)).sort_values(["time", "v_net_id"], kind="stable")
        out = []
        for r in rows.itertuples():
            left += sum(d for t, d in active if t < r.time)
            active = [(t, d) for t, d in active if t >= r.time]
            ok = r.demand <= left
            if ok:
                left -= r.demand
                active.append((r.time + r.lifetime, r.demand))
            out.append((key[0], r.v_net_id, r.time, bool(ok), left))
        state.update((left, active))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ADMITTED.split(", ")])

    return events.groupBy("network").applyInPandasWithState(step, ADMITTED, "available double, active array<struct<leave:double,demand:double>>", "append", GroupStateTimeout.NoTimeout)
