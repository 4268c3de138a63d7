"""A capacity store in event time: leases end on their time, arrivals are admitted in the order of their times.

The stream form keeps arrivals until the watermark has passed them, so that any order within the watermark's
delay gives the admissions of the batch form; an arrival later than that is left out, as a row behind the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ADMITTED = "network string, v_net_id long, time long, accepted boolean, available double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def admit(left: float, leases: dict[tuple[int, int], float], arrivals: list[tuple[int, int, int, float]]) -> tuple[float, list[tuple[int, int, bool, float]], list[tuple[int, int]], dict[tuple[int, int], float]]:
    """Arrivals (time, id, lifetime, demand) in this order against the capacity ``left`` and the ``leases`` {(end, id): demand}.

    Returns the capacity left, the admissions (time, id, accepted, available), the ended leases and the new ones that still run.
    A lease that ends before an arrival is released first; one that ends with it still holds.
    """
    running, out = dict(leases), []
    for time, own, lifetime, demand in arrivals:
        for end in sorted(k for k in running if k[0] < time):
            left += running.pop(end)
        ok = demand <= left
        if ok:
            left -= demand
            running[time + lifetime, own] = demand
        out.append((time, own, ok, left))
    return left, out, [k for k in leases if k not in running], {k: d for k, d in running.items() if k not in leases}


def prepared(events: DataFrame, network: str, time: str) -> DataFrame:
    """(network, ts, v_net_id, time in microseconds, lifetime in microseconds, demand); rows without one of them go."""
    rows = events.select(F.col(network).cast("string").alias("network"), F.col(time).alias("ts"), F.col("v_net_id").cast("long").alias("v_net_id"), F.unix_micros(time).alias("time"), (F.col("lifetime") * 1_000_000).cast("long").alias("lifetime"), F.col("demand").cast("double").alias("demand"))
    return rows.dropna()


def admissions(events: DataFrame, capacity: float, network: str = "network", time: str = "ts") -> DataFrame:
    """The batch form: (network, v_net_id, time, accepted, available); a network's arrivals are one sequence."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["time", "v_net_id"])
        _, out, _, _ = admit(capacity, {}, list(zip(rows["time"], rows["v_net_id"], rows["lifetime"], rows["demand"])))
        found = pd.DataFrame(out, columns=["time", "v_net_id", "accepted", "available"])
        found["network"] = frame["network"].iloc[0]
        return found[["network", "v_net_id", "time", "accepted", "available"]]

    return prepared(events, network, time).drop("ts").dropDuplicates(["network", "time", "v_net_id"]).groupBy("network").applyInPandas(run, ADMITTED)


class CapacityStore(StatefulProcessor):
    """A network's capacity, its leases by end and id, its waiting arrivals by time and id, and one timer for the next of these."""

    def __init__(self, capacity: float):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getValueState("left", "available double")
        self.leases = handle.getMapState("leases", "end long, v_net_id long", "demand double")
        self.waiting = handle.getMapState("waiting", "time long, v_net_id long", "lifetime long, demand double")
        self.timer = handle.getValueState("timer", "at long")

    def _arm(self, time: int) -> None:
        """The timer fires once the watermark is past ``time``; an earlier one stays."""
        at = time // 1000 + 1
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            for r in frame.itertuples():
                own = (int(r.time), int(r.v_net_id))
                if not self.waiting.containsKey(own):
                    self.waiting.updateValue(own, (int(r.lifetime), float(r.demand)))
                    first = own[0] if first is None else min(first, own[0])
        if first is not None:
            self._arm(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((k, v) for k, v in self.waiting.iterator())
        now = [(k[0], k[1], v[0], v[1]) for k, v in held if k[0] < passed]
        left = self.left.get()[0] if self.left.exists() else self.capacity
        leases = {(k[0], k[1]): v[0] for k, v in self.leases.iterator()}
        left, out, ended, new = admit(left, leases, now)
        self.left.update((left,))
        for k in ended:
            self.leases.removeKey(k)
        for k, d in new.items():
            self.leases.updateValue(k, (d,))
        for k in now:
            self.waiting.removeKey((k[0], k[1]))
        if len(held) > len(now):
            self._arm(held[len(now)][0][0])
        yield pd.DataFrame([(key[0], i, t, ok, a) for t, i, ok, a in out], columns=["network", "v_net_id", "time", "accepted", "available"])

    def close(self) -> None:
        pass


def capacity_stream(events: DataFrame, capacity: float, late: str, network: str = "network", time: str = "ts") -> DataFrame:
    """The stream form of ``admissions``; an arrival may be as late as ``late`` behind the latest one. It needs the RocksDB state store."""
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    rows = prepared(events, network, time).withWatermark("ts", late)
    return rows.groupBy("network").transformWithStateInPandas(CapacityStore(capacity), ADMITTED, "Append", "EventTime")
