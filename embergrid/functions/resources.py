"""Scalar resource arithmetic and constraint predicates as Column expressions (no UDFs)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LE, GE, EQ = "le", "ge", "eq"


def satisfied(demand: Column, capacity: Column, how: str = LE, soft: bool = False) -> Column:
    """Whether a demand fits a capacity; a soft constraint always holds."""
    if how not in (LE, GE, EQ):
        raise ValueError(f"unknown comparison {how!r}")
    test = {LE: demand <= capacity, GE: demand >= capacity, EQ: demand == capacity}[how]
    return test | F.lit(soft)


def offset(demand: Column, capacity: Column, how: str = LE) -> Column:
    """How far a demand is over (positive) or under its bound."""
    if how not in (LE, GE, EQ):
        raise ValueError(f"unknown comparison {how!r}")
    return {LE: demand - capacity, GE: capacity - demand, EQ: F.abs(demand - capacity)}[how]


def check(pairs: Mapping[str, tuple[Column, Column]], how: str = LE, soft: bool = False) -> tuple[Column, Column]:
    """(all constraints hold, struct of the offsets by name)."""
    flag = reduce(lambda a, b: a & b, (satisfied(d, c, how, soft) for d, c in pairs.values()), F.lit(True))
    return flag, F.struct(*[offset(d, c, how).alias(name) for name, (d, c) in pairs.items()])


def path_latency_ok(latencies: Column, bound: Column, how: str = GE) -> Column:
    """The bound against the sum of the latencies along a path."""
    total = F.aggregate(latencies, F.lit(0.0), lambda a, x: a + x)
    return satisfied(bound, total, how)


def path_ok(link_flags: Column, latency_flag: Column | None = None) -> Column:
    """Every hop feasible and, if given, the path constraint, too."""
    every = F.forall(link_flags, lambda x: x)
    return every if latency_flag is None else every & latency_flag


def violation(offsets: Column) -> Column:
    """Sum of the positive offsets of an array."""
    return F.aggregate(offsets, F.lit(0.0), lambda a, x: a + F.greatest(x.cast("double"), F.lit(0.0)))


def add(capacity: Column, amount: Column) -> Column:
    return capacity + amount


def subtract(capacity: Column, amount: Column, name: str = "resource", safe: bool = True) -> Column:
    """Debit; a safe debit raises where the amount exceeds the capacity."""
    if not safe:
        return capacity - amount
    message = F.concat(F.lit(f"{name}: (v = "), amount.cast("string"), F.lit(") > (p = "), capacity.cast("string"), F.lit(")"))
    return F.when(amount > capacity, F.raise_error(message).cast("double")).otherwise(capacity - amount)


def clip(value: Column, low: Column, high: Column) -> Column:
    """NaN stays NaN; with low above high the result is high."""
    return F.when(F.isnan(value.cast("double")), value).otherwise(F.least(F.greatest(value, low), high))


def euclidean_latency(a: Column, b: Column, low: float, high: float) -> Column:
    """Distance of two positions scaled to [low, high]; positions must agree in dimension."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    scaled = distance * (high - low) + low
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("positions differ in dimension")).cast("double")).otherwise(scaled)


def position(x: Column, y: Column, r: Column, low: float, high: float) -> Column:
    return F.array(x, y, clip(r, F.lit(low), F.lit(high)))


def mean_skip_nan(x: Column) -> Column:
    return F.avg(F.when(~F.isnan(x), x))


def sum_skip_nan(x: Column) -> Column:
    return F.coalesce(F.sum(F.when(~F.isnan(x), x)), F.lit(0.0))


def min_skip_nan(x: Column) -> Column:
    return F.min(F.when(~F.isnan(x), x))


def utilisation(available: Column, initial: Column) -> Column:
    """1 - available / initial; a zero initial capacity is an error."""
    return F.when(initial == 0, F.raise_error(F.lit("initial capacity is zero")).cast("double")).otherwise(1 - available / initial)


def admitted(violation_: Column, ratio: Column, size: Column, ratio_threshold: float = 0.0, size_threshold: int = 10_000) -> Column:
    """Admission: no hard violation, and not both a low revenue ratio and a large request."""
    return (violation_ <= 0) & ~((ratio < ratio_threshold) & (size > size_threshold))


def window_index(time: Column, origin: float, size: float) -> Column:
    """Tumbling window of a time; times before the origin or not finite are errors."""
    if not size > 0:
        raise ValueError("window size must be positive")
    bad = F.isnan(time) | (time < origin) | time.isin(float("inf"))
    return F.when(bad, F.raise_error(F.lit("time before the origin or not finite")).cast("long")).otherwise(F.floor((time - origin) / size).cast("long"))
