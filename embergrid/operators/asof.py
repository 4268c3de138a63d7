"""As-of join of two event tables: each left row with the last right row of its key up to its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, order: str, values: Sequence[str], strict: bool = False, ranges: int | None = None) -> DataFrame:
    """All rows of ``left`` with the columns ``values`` of the last row of ``right``, by ``time``, then ``order``, of the same keys.

    That row's time is at most the left row's, or before it with ``strict``; without such a row the values are null.
    ``order`` tells rows of one time apart; left rows of one key and time match alike. Rows of null keys or a null time match
    nothing. Both tables are merged, and the last right row is carried over ranges of (key, time), so a hot key is split.
    """
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    known = F.lit(True)
    for c in (*keys, time):
        known = known & F.col(c).isNotNull()
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    at = [F.struct(*keys).alias("k"), F.col(time).alias("t")]
    # at one time, what a left row may see comes before it
    seen = right.where(known).select(*at, F.lit(1 if strict else 0).alias("s"), F.col(order).alias("o"), F.struct(*values).alias("v"))
    rows = left.where(known).select(*at, F.lit(0 if strict else 1).alias("s"), none(right, order).alias("o"), F.struct(*left.columns).alias("l"))
    merged = seen.unionByName(rows, allowMissingColumns=True)
    out = running(merged, ["k"], ["t", "s", "o"], lasts={"last": F.col("v")}, ranges=ranges).where("l is not null")
    out = out.select(*[F.col("l")[c].alias(c) for c in left.columns], *[F.col("last")[v].alias(v) for v in values])
    rest = left.where(~known).select(*left.columns, *[none(right, v).alias(v) for v in values])
    return out.union(rest)
