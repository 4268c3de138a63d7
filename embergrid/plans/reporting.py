"""Sinks of a run: records, JSON report, file names, metric sinks, progress, run folders."""

from __future__ import annotations

import json
import logging
import shutil
import time
from collections.abc import Callable, Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_records(records: DataFrame) -> DataFrame:
    """Nested columns as JSON text, ready for CSV."""
    nested = [c for c, kind in records.dtypes if kind.startswith(("map", "array", "struct"))]
    return records.withColumns({c: F.to_json(c) for c in nested})


def save_records(records: DataFrame, path: str, append: bool = False) -> None:
    """Records as Parquet; dynamic columns of later runs merge on reading."""
    records.write.mode("append" if append else "errorifexists").parquet(path)


def load_records(spark, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


MAX_ROWS = 100_000


def run_report(summary: DataFrame, windows: DataFrame | None = None, full: bool = False) -> str:
    """A JSON report of one run's small tables: the summary, and with ``full`` its windows. More than ``MAX_ROWS`` rows are an error."""

    def rows(df: DataFrame) -> list[dict]:
        found = df.limit(MAX_ROWS + 1).collect()
        if len(found) > MAX_ROWS:
            raise ValueError(f"more than {MAX_ROWS} rows in a report; write them as a table")
        return [r.asDict(True) for r in found]

    out: dict = {"summary": rows(summary)}
    if full and windows is not None:
        out["windows"] = rows(windows.orderBy("window"))
    return json.dumps(out, default=str, sort_keys=True)


def file_name(prefix: str, items: Iterable[tuple[str, object]], epoch: int | None = None, suffix: str = "") -> str:
    """A name from ordered parameters; floats as Python writes them, lists joined by dashes."""

    def text(value) -> str:
        return "-".join(map(text, value)) if isinstance(value, (list, tuple)) else repr(value) if isinstance(value, float) else str(value)

    parts = [prefix, *[f"{k}_{text(v)}" for k, v in items], *([] if epoch is None else [f"epoch_{epoch}"])]
    return "-".join(p for p in parts if p) + suffix


def file_name_column(prefix: str, names: Iterable[str]) -> Column:
    return F.concat_ws("-", F.lit(prefix), *[F.concat(F.lit(f"{n}_"), F.col(n).cast("string")) for n in names])


def clean_run_folder(folder: str, root: str) -> None:
    """Delete a run's folder, only inside ``root``."""
    target, base = Path(folder).resolve(), Path(root).resolve()
    if base not in target.parents:
        raise ValueError(f"{target} is not inside {base}")
    if target.exists():
        shutil.rmtree(target)


class MetricLog:
    """Named metrics to a logger and to attached sinks, every ``interval`` steps."""

    def __init__(self, name: str = "embergrid", interval: int = 1, file: str | None = None):
        self.logger, self.interval, self.sinks, self.step = logging.getLogger(name), max(1, interval), [], 0
        if file:
            self.logger.addHandler(logging.FileHandler(file, encoding="utf-8"))

    def attach(self, sink: Callable[[int, dict], None]) -> None:
        self.sinks.append(sink)

    def log(self, metrics: dict) -> None:
        self.step += 1
        if self.step % self.interval == 0:
            self.logger.info("step %d: %s", self.step, metrics)
            for sink in self.sinks:
                sink(self.step, dict(metrics))


class Progress:
    """A rate-limited counter; frames go to ``write``."""

    def __init__(self, total: int, write: Callable[[str], None] = print, every: float = 0.1):
        self.total, self.write, self.every, self.last, self.done = total, write, every, 0.0, 0

    def update(self, done: int) -> None:
        self.done = done
        now = time.monotonic()
        if done >= self.total or now - self.last >= self.every:
            self.last = now
            self.write(f"{done}/{self.total} ({100 * done / max(self.total, 1):.0f} %)")


def observed(df: DataFrame, name: str, **metrics: Column):
    """The frame and an observation that fills while an action runs."""
    from pyspark.sql import Observation

    observation = Observation(name)
    return df.observe(observation, *[m.alias(k) for k, m in metrics.items()]), observation


def extended_summary(summary: DataFrame, extensions: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Extra summary columns, each function from frame to frame."""
    return reduce(lambda df, f: f(df), extensions, summary)
