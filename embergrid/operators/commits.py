"""Parallel commits of transactions that debit shared targets, equal to committing them one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running
from .storage import saved


def commit_updates(updates: DataFrame, capacity: DataFrame, priority: str | None = None, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(txn, committed, round), and (target, left): what committing one by one in the order of ``priority`` gives.

    ``updates`` has txn, target and amount (not negative), ``capacity`` target and left. A transaction commits where
    every target holds its amount, with all its debits or none. Without ``priority``, a column of ``updates`` with
    one value for each transaction, a hash of txn orders them; txn settles ties.

    In a round, a transaction that fits every target even if all earlier ones that are undecided commit is certain to
    commit, and one that a target can't hold after the certain debits is certain to fail; later commits never take what
    an undecided one before them needs, as they left room for it. The first undecided one is always certain. Totals over
    a target's transactions run in ranges, so a hot target is split. A target without a capacity holds nothing.
    """
    rank = F.col(priority) if priority else F.xxhash64("txn")
    pending = saved(updates.groupBy("txn", "target").agg(F.sum("amount").alias("amount"), F.min(rank).alias("p")))
    left = saved(capacity.select("target", "left").union(pending.select("target", F.lit(0)).distinct().join(capacity.select("target"), "target", "left_anti")))
    decided, n = None, 0
    while not pending.isEmpty():
        n += 1
        rows = running(pending, ["target"], ["p", "txn"], sums={"upto": F.col("amount")}, ranges=ranges).join(left, "target")
        state = saved(rows.groupBy("txn").agg(F.bool_and(F.col("upto") <= F.col("left")).alias("sure"), F.bool_or(F.col("amount") > F.col("left")).alias("lost")))
        now = state.where("sure or lost").select("txn", F.col("sure").alias("committed"), F.lit(n).alias("round"))
        decided = now if decided is None else decided.union(now)
        debits = pending.join(now.where("committed"), "txn").groupBy("target").agg(F.sum("amount").alias("debit"))
        left = saved(left.join(debits, "target", "left").select("target", (F.col("left") - F.coalesce("debit", F.lit(0))).alias("left")))
        pending = saved(pending.join(now.select("txn"), "txn", "left_anti").select("txn", "target", "amount", "p"))
    if decided is None:
        decided = updates.where("false").select("txn", F.lit(True).alias("committed"), F.lit(0).alias("round"))
    return decided, left
