"""Filter interaction audit: what each filter removes under every order of the filters.

A document's failures are one bit mask, so the corpus shrinks to counts by (part, mask). A walk
through all orders by adjacent transpositions swaps two neighbouring filters at a time; only their
two steps are summed up anew from the mask cells, and the Shapley totals accumulate along the walk,
each step's removals times the number of orders they stood for.

Defined results: a null text is empty; a null part is the empty string; a null doc_id takes no part
in the duplicate filter and has no labels; rows that repeat a doc_id count as documents of their own,
and are no duplicates of each other; several labels of one document hold if any of them does; texts
are compared whole, by SHA-256; an empty table has no parts and so no rows; other columns of the
tables play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, written

MOST_FILTERS = 8
ROWS_AT_ONCE = 500_000
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions A to D: too few words, too few distinct words, too many capitals, odd symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def plain_changes(n: int) -> Iterator[int]:
    """Positions ``i`` whose neighbours ``i`` and ``i + 1`` swap, so that each order of ``n`` is visited once."""
    if n < 2:
        return
    inner = plain_changes(n - 1)
    while True:
        yield from range(n - 2, -1, -1)
        if (i := next(inner, None)) is None:
            return
        yield i + 1
        yield from range(n - 1)
        if (i := next(inner, None)) is None:
            return
        yield i


def walk(cells: np.ndarray, names: str) -> tuple[list[str], np.ndarray]:
    """All orders in the walk's sequence, and COUNTS by [part, order, step]; ``cells`` is [part, mask, (documents, good, toxic)]."""
    n, masks = len(names), np.arange(cells.shape[1])
    order = list(range(n))
    orders, out = [], np.zeros((len(cells), factorial(n), n, len(COUNTS)), dtype=np.int64)
    now, since, shares = np.zeros((len(cells), n, 6), dtype=np.int64), [0] * n, np.zeros((len(cells), n), dtype=np.int64)

    def step(k: int) -> None:
        bit, before = 1 << order[k], sum(1 << f for f in order[:k])
        fails, gone = masks & bit > 0, masks & before > 0
        lost = cells[:, fails & ~gone].sum(axis=1)
        now[:, k, 0] = cells[:, ~fails & ~gone, 0].sum(axis=1)
        now[:, k, 1], now[:, k, 4], now[:, k, 5] = lost.T
        now[:, k, 2] = cells[:, fails & gone, 0].sum(axis=1)
        now[:, k, 3] = cells[:, bit, 0]

    def settle(k: int, visit: int) -> None:
        shares[:, order[k]] += now[:, k, 1] * (visit - since[k])
        since[k] = visit

    for k in range(n):
        step(k)
    changes = plain_changes(n)
    for visit in range(factorial(n)):
        orders.append("".join(names[f] for f in order))
        out[:, visit, :, :6] = now
        for k in range(n):
            out[:, visit, k, 6] = order[k]  # the filter, until its total is known
        i = next(changes, None)
        if i is None:
            break
        for k in (i, i + 1):
            settle(k, visit + 1)
        order[i], order[i + 1] = order[i + 1], order[i]
        for k in (i, i + 1):
            step(k)
    for k in range(n):
        settle(k, factorial(n))
    parts = np.arange(len(cells))[:, None, None]
    out[..., 6] = shares[parts, out[..., 6]]
    return orders, out


def audit_cells(cells: DataFrame, names: str) -> DataFrame:
    """The audit of ``cells`` (part, mask, n, good, toxic): a row for each part, order and step."""
    n = len(names)
    if not 1 <= n <= MOST_FILTERS or len(set(names)) != n:
        raise ValueError(f"one to {MOST_FILTERS} filters with different letters")
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^n entries at most
    at_once = max(1, ROWS_AT_ONCE // (factorial(n) * n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                own = batch.slice(at, at_once)
                dense = np.zeros((own.num_rows, 1 << n, 3), dtype=np.int64)
                for i, found in enumerate(own.column(1).to_pylist()):
                    for c in found:
                        dense[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                orders, counts = walk(dense, names)
                each = len(orders) * n
                columns = [own.column(0).take(pa.array(np.repeat(np.arange(own.num_rows), each))), pa.array(np.tile(np.repeat(np.array(orders, dtype=object), n), own.num_rows), pa.string()), pa.array(np.tile(np.arange(1, n + 1), own.num_rows * len(orders)), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(counts[..., c].ravel()) for c in range(len(COUNTS))]], names=["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], duplicate: str | None = None, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, COUNTS) of ``filters``, one-letter names of conditions on the columns of ``docs`` that hold where a document fails.

    ``duplicate`` is the letter of one more filter: texts that a smaller doc_id has, too, removed or not.
    Only ids, digests and masks are shuffled, never texts; a hot text meets others only in partial minima.
    """
    names = "".join(filters) + (duplicate or "")
    mask = sum((F.coalesce(fails, F.lit(False)).cast("int") * (1 << k) for k, fails in enumerate(filters.values())), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    facts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), *([digest.alias("digest")] if duplicate else []))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    if duplicate:
        facts = written(facts, "facts")
        first = facts.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
        again = F.col("id").isNotNull() & F.col("first").isNull()
        facts = facts.join(first, ["digest", "id"], "left").select("id", "part", (F.col("mask") + again.cast("int") * (1 << (len(names) - 1))).alias("mask"))
    rows = facts.join(known, "id", "left")
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in ("good", "toxic")])
    return audit_cells(cells, names)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit(docs, labels, text_filters(F.coalesce(F.col("text"), F.lit(""))), duplicate="E")


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), m AS (
  SELECT doc_id, part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x))::INT + 8 * regexp_matches(x, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)::INT AS mask FROM t
), g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN g USING (doc_id) GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
k AS (
  SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS f,
    coalesce(list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(substr(filter_order, j, 1)) - 65))), 0)::INT AS b
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)
), r AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (mask & (b | f) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & f > 0 AND mask & b = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & f > 0 AND mask & b > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & f > 0 AND mask & b = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & f > 0 AND mask & b = 0), 0)::BIGINT AS toxic_lost
  FROM c, k GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
