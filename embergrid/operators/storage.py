"""Materialised intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(sc) -> None:
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="embergrid-"))


def saved(df: DataFrame) -> DataFrame:
    """A table written once into the shared checkpoint folder (a temporary one in local mode where none is set) and read back.

    It cuts the lineage and outlives executors. Unlike a checkpoint it has the sizes of its files, not an estimate
    that a loop of joins multiplies from round to round, so small sides are broadcast and large ones never.
    """
    path = folder(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_in = path.rsplit("/", 1)[0]
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._saved_in)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Shuffle files of each table written inside go when it is written, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


PART_ROWS = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over partitions of about ``PART_ROWS`` rows, so that a task's memory stays as the table grows.

    For groups of nearly unique keys, which partial sums before the shuffle only hold in memory twice. The rows are counted
    first: hand over a table, or what is as cheap to read.
    """
    return df.repartition(_parts(df), *keys)


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """As ``dealt``, by ranges of ``keys``: equal rows meet, rows with an equal first key lie side by side."""
    return df.repartitionByRange(_parts(df), *keys)


def _parts(df: DataFrame) -> int:
    return max(-(-df.count() // PART_ROWS), df.sparkSession.sparkContext.defaultParallelism)


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder."""
    sc = spark.sparkContext
    _shared(sc)
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/embergrid-{uuid.uuid4().hex}/{label}"
