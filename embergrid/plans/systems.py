"""Run modes over the simulation kernels: online, offline, time window and changeable stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import accounting, simulate

MODES = ("changeable", "offline", "time_window", "online")  # in order of precedence


def mode_of(settings: dict) -> str:
    return next((m for m in MODES[:-1] if settings.get(m)), "online")


def run_table(spark: SparkSession, solvers: Sequence[str], seeds: Sequence[int] = (0,), epochs: int = 1) -> DataFrame:
    """Runs of every solver, seed and epoch; epochs count the seed on."""
    rows = [(s, seed + e, e) for s in solvers for seed in seeds for e in range(epochs)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "run_id long, solver string, seed int, epoch int")


def online(spark, physical, nested, solvers, resources, bandwidths, seeds=(0,), epochs: int = 1) -> tuple[DataFrame, DataFrame]:
    """(records with running state, summaries), every epoch on a pristine network."""
    records = simulate.online_runs(spark, physical, nested, run_table(spark, solvers, seeds, epochs), resources, bandwidths)
    state = accounting.running_state(records)
    return state, accounting.run_summary(state)


def offline(spark, physical, nested, solver, resources, bandwidths) -> DataFrame:
    """One row: shares over all requests; a failure counts in the first class that it meets."""
    rows = simulate.offline_runs(spark, physical, nested, solver, resources, bandwidths)
    return rows.agg(
        F.avg(F.col("result").cast("double")).alias("acceptance_rate"),
        F.avg("r2c").alias("avg_r2c"),
        F.count_if(~F.col("place_result")).alias("place_failures"),
        F.count_if(F.col("place_result") & ~F.col("route_result")).alias("route_failures"),
        F.max(F.col("result").cast("long")).alias("max_inservice"),
    )


def time_window(spark, physical, nested, solver, resources, bandwidths, size: float, origin: float = 0.0) -> DataFrame:
    records = simulate.online_runs(spark, physical, nested, run_table(spark, [solver]), resources, bandwidths)
    return accounting.window_summary(records, origin, size)


def changeable(spark, stages: Sequence[tuple], solver, resources, bandwidths, seed: int = 0) -> DataFrame:
    """Stages (physical, nested) in turn, stage k seeded with seed + k; epochs count on."""
    parts = []
    for k, (physical, nested) in enumerate(stages):
        runs = run_table(spark, [solver], [seed + k])
        parts.append(simulate.online_runs(spark, physical, nested, runs, resources, bandwidths).withColumn("epoch", F.lit(0)))
    return accounting.concatenate_stages(parts, list(range(len(stages))))
