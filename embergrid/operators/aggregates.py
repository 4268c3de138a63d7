"""Aggregations over networks: resource sums, link aggregates, degrees, sparse matrices, benchmarks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .attributes import closure
from .storage import dealt


def resource_sum(table: DataFrame, resources: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sum of all resources; a missing value is an error, no resource gives 0."""
    total: Column = reduce(lambda a, b: a + b, [F.coalesce(F.col(r), F.raise_error(F.lit(f"missing {r}")).cast("double")) for r in resources], F.lit(0.0))
    return table.groupBy(*by).agg(F.coalesce(F.sum(total), F.lit(0.0)).alias("total"))


def degree(nodes: DataFrame, links: DataFrame, how: str = "any") -> DataFrame:
    """Degrees of all nodes; a self-loop counts twice."""
    ends = {"out": ["src"], "in": ["dst"], "any": ["src", "dst"]}[how]
    rows = reduce(DataFrame.unionAll, [links.select(F.col(c).alias("id")) for c in ends])
    counts = rows.groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def link_aggregate(nodes: DataFrame, links: DataFrame, name: str, how: str = "sum", n: int | None = None) -> DataFrame:
    """Per node the sum, mean, max or min of a link attribute over its dense adjacency column.

    Structural zeros take part: the mean divides by the number of nodes, the minimum is at most 0
    unless the column is full, the maximum at least 0.
    """
    n = nodes.count() if n is None else n
    by = closure(links).groupBy(F.col("dst").alias("id")).agg(F.sum(name).alias("s"), F.max(name).alias("hi"), F.min(name).alias("lo"), F.count("*").alias("k"))
    out = nodes.select("id").join(by, "id", "left")
    zero, full = F.lit(0), F.col("k") >= n
    value = {
        "sum": F.coalesce("s", zero),
        "mean": F.coalesce("s", zero) / n,
        "max": F.when(full, F.col("hi")).otherwise(F.greatest(F.coalesce("hi", zero), zero)),
        "min": F.when(full, F.col("lo")).otherwise(F.least(F.coalesce("lo", zero), zero)),
    }[how]
    return out.select("id", value.alias("value"))


def sparse_matrix(links: DataFrame, name: str | None = None, directed: bool = False, normalised: bool = False, whole_rows: bool = False) -> DataFrame:
    """(row, col, value) without zeros; a missing weight is 1. With ``whole_rows``, a row's entries lie in one partition."""
    value = F.coalesce(F.col(name).cast("double"), F.lit(1.0)) if name else F.lit(1.0)
    arcs = links if directed else closure(links)
    entries = arcs.select(F.col("src").alias("row"), F.col("dst").alias("col"), value.alias("value"))
    entries = dealt(entries, "row") if normalised or whole_rows else dealt(entries, "row", "col")
    out = entries.groupBy("row", "col").agg(F.sum("value").alias("value")).where("value <> 0")
    if normalised:
        scale = 1 / F.sum("value").over(Window.partitionBy("row"))
        out = out.withColumn("value", F.col("value") * scale)
    return out


def to_csr(matrix: DataFrame) -> DataFrame:
    """A row for each matrix row: sorted columns, values and how many."""
    entries = F.array_sort(F.collect_list(F.struct("col", "value")))
    rows = matrix.groupBy("row").agg(entries.alias("e"))
    return rows.select("row", F.transform("e", lambda x: x["col"]).alias("cols"), F.transform("e", lambda x: x["value"]).alias("vals"), F.size("e").alias("nnz"))


def attribute_benchmarks(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Maximum of each attribute in single precision, a row for each name."""
    wide = table.agg(*[F.max(F.col(n).cast("float")).alias(n) for n in names])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("maximum")) for n in names])).alias("x")).select("x.*")


def attribute_extrema(table: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Maximum by the initial capacities: a row for each attribute whose copy of initial values, its extremum, is named."""
    wide = table.agg(*[F.max(F.col(extremum).cast("float")).alias(n) for n, extremum in pairs.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("maximum")) for n in pairs])).alias("x")).select("x.*")


def network_size(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: num_nodes and num_edges."""
    counts = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(links.select(F.lit(0), F.lit(1)))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("num_edges"))


def pooled_offsets(checks: DataFrame, keys: Sequence[str], offset: str = "offset") -> DataFrame:
    """Per key the largest offset and the sum of the positive ones."""
    return checks.groupBy(*keys).agg(F.max(offset).alias("max_offset"), F.sum(F.greatest(F.col(offset), F.lit(0))).alias("violation"))


def duplicate_targets(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Targets that several updates of one batch touch."""
    return updates.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def apply_deltas(table: DataFrame, deltas: DataFrame, keys: Sequence[str], resource: str, amount: str = "amount") -> DataFrame:
    """Capacities after debits (negative) and credits, summed per target before the join."""
    sums = deltas.groupBy(*keys).agg(F.sum(amount).alias("__d"))
    return table.join(sums, list(keys), "left").withColumn(resource, F.col(resource) + F.coalesce("__d", F.lit(0))).drop("__d")
