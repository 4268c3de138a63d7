"""Running totals, last and greatest values over long groups, cut into ranges, so that no group lies in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, maxes: Mapping[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums`` (the total up to and with the row) and ``lasts`` (the last
    non-null value) and ``maxes`` (the greatest value).

    Rows run by the columns ``order`` within equal ``keys``; null keys are equal, rows equal in keys and order run as one
    would read them. The table is cut into ranges of (keys, order) and written once; a range is one window's partition, and
    only a range's first and last key, two rows of each range, meet to carry totals over the bounds.
    """
    sums, lasts, maxes = dict(sums or {}), dict(lasts or {}), dict(maxes or {})
    own = {f"__{name}": c for name, c in (sums | lasts | maxes).items()}
    place = ["__k", *order]
    rows = df.select("*", F.struct(F.lit(0).alias("__0"), *keys).alias("__k"), *[c.alias(n) for n, c in own.items()])
    dealt = rows.repartitionByRange(ranges, *place) if ranges else rows.repartitionByRange(*place)
    rows = saved(dealt.withColumn("__p", F.spark_partition_id()))
    ends = rows.groupBy("__p").agg(F.min("__k").alias("lo"), F.max("__k").alias("hi"))
    cut = ends.select("__p", F.explode(F.array("lo", "hi")).alias("__k")).distinct()
    totals = [F.sum(f"__{n}").alias(f"__t_{n}") for n in sums] + [F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.struct(*order))).alias(f"__t_{n}") for n in lasts] + [F.max(f"__{n}").alias(f"__t_{n}") for n in maxes]
    parts = cut.join(rows, ["__p", "__k"]).groupBy("__p", "__k").agg(*totals)
    before = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.sum(f"__t_{n}").over(before).alias(f"__t_{n}") for n in sums] + [F.last(f"__t_{n}", ignorenulls=True).over(before).alias(f"__t_{n}") for n in lasts] + [F.max(f"__t_{n}").over(before).alias(f"__t_{n}") for n in maxes]
    inside = Window.partitionBy("__p", "__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"__r_{n}": F.sum(f"__{n}").over(inside) for n in sums} | {f"__r_{n}": F.last(f"__{n}", ignorenulls=True).over(inside) for n in lasts} | {f"__r_{n}": F.max(f"__{n}").over(inside) for n in maxes})
    out = out.join(parts.select("__p", "__k", *carry), ["__p", "__k"], "left")
    found = [F.when(F.col(f"__r_{n}").isNotNull() | F.col(f"__t_{n}").isNotNull(), F.coalesce(f"__r_{n}", F.lit(0)) + F.coalesce(f"__t_{n}", F.lit(0))).alias(n) for n in sums]
    return out.select(*df.columns, *found, *[F.coalesce(f"__r_{n}", f"__t_{n}").alias(n) for n in lasts], *[F.greatest(f"__r_{n}", f"__t_{n}").alias(n) for n in maxes])
