"""Operator 2 [native]: text quality rules, host-level failure rates and host verdicts.

Document rules fail a text; failures are summed per host, each host's rate is shrunk towards an
empirical beta prior (method of moments over hosts), and the verdict of the host joins back to
its documents. Only DataFrame functions are used, and the text is read in one pass without a
shuffle: only the slim digest columns are written and joined.

Defined results: a null text has no words and fails; a null host is no host, its documents are
judged by their own text only; with fewer than two hosts, or no spread of rates, the prior is
Beta(``weight`` * mean, ``weight`` * (1 - mean)). Repeated rows count and return as often as
they occur. Columns of the result are fixed; extra input columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, written

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.6
PRIOR_WEIGHT = 10.0


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != F.lit(""))


def with_repeated_words(df: DataFrame, words: str, out: str, width: int = 3) -> DataFrame:
    """``df`` with the number of words covered by windows of ``width`` words that occur twice or more.

    Window hashes with their positions are sorted as packed numbers; only windows whose 32-bit
    hash has an equal neighbour are then sorted as text, and equal neighbours are covered.
    """
    n, w = F.size(words), F.col(words)
    starts = F.sequence(F.lit(0), n - width)
    packed = F.transform(starts, lambda i: F.shiftleft(F.hash(*[F.get(w, i + k) for k in range(width)]).cast("long"), 32).bitwiseOR(i.cast("long")))
    df = df.withColumn("__packed", F.when(n > width, F.sort_array(packed)))

    def top(x: Column) -> Column:
        return F.shiftright(x, 32)

    s = F.col("__packed")
    near = F.filter(s, lambda x, k: (top(x) == top(F.get(s, k - 1))) | (top(x) == top(F.get(s, k + 1))))
    df = df.withColumn("__near", F.transform(near, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")))

    def covered(t: Column) -> Column:
        doubled = F.filter(F.transform(t, lambda x, k: F.when((x["w"] == F.get(t, k - 1)["w"]) | (x["w"] == F.get(t, k + 1)["w"]), x["i"])), lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(doubled, lambda i: F.array(*[i + k for k in range(width)])))))

    texts = F.transform(F.col("__near"), lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]).alias("w"), i.alias("i")))
    repeated = F.when(F.size("__near") > 0, let(F.sort_array(texts), covered)).otherwise(0)
    return df.withColumn(out, repeated.cast("long")).drop("__packed", "__near")


def text_rules(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """``df`` without the text, with the measures of it and ``base_failed``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = df.withColumn("__w", words_of(F.col(text)))
    out = words.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    ).drop(text)
    out = with_repeated_words(out, "__w", "n_repeat_words").drop("__w")
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(judged: DataFrame, host: str = "source", failed: str = "base_failed", weight: float = PRIOR_WEIGHT) -> DataFrame:
    """Per host: documents, failures and the failure rate's posterior mean under the fitted prior."""
    per_host = judged.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    moments = per_host.agg(
        F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(F.lit(1.0) / F.col("host_docs")).alias("inv_n"), F.count("*").alias("hosts")
    )
    # Var(rate) = m(1-m) [rho + (1-rho) E(1/n)], prior weight = 1/rho - 1
    spread = F.col("v") / (F.col("m") * (1 - F.col("m")))
    rho = (spread - F.col("inv_n")) / (1 - F.col("inv_n"))
    fitted = F.when((F.col("hosts") > 1) & (F.col("m") > 0) & (F.col("m") < 1) & (F.col("inv_n") < 1) & (rho > 1e-4) & (rho < 1), 1 / rho - 1).otherwise(F.lit(weight))
    prior = moments.select((F.col("m") * fitted).alias("alpha"), fitted.alias("prior_weight"))
    shrunk = (F.col("host_failures") + F.col("alpha")) / (F.col("host_docs") + F.col("prior_weight"))
    return per_host.join(prior).select(host, "host_docs", "host_failures", shrunk.alias("host_rate"))


def quality(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per row: the measures, ``base_failed``, the host's shrunk rate and ``kept``."""
    judged = written(text_rules(df.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("source"), F.col(text).alias("text"))), "quality")
    rates = host_rates(judged).withColumnRenamed("source", "__host")
    out = judged.join(rates, F.col("source") == F.col("__host"), "left")
    bad = F.coalesce(F.col("host_rate") > max_rate, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~bad).drop("__host", "host_docs", "host_failures")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    out = quality(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (
  SELECT w.r, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN ln ON w.r = ln.r LEFT JOIN rep ON w.r = rep.r
), b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
mo AS (SELECT avg(f / n) AS m, var_samp(f / n) AS v, avg(1.0::DOUBLE / n) AS q, count(*) AS k FROM h),
rho AS (SELECT m, k, q, CASE WHEN m > 0 AND m < 1 AND q < 1 THEN (v / (m * (1 - m)) - q) / (1 - q) END AS rho FROM mo),
pr AS (SELECT m, CASE WHEN k > 1 AND rho > 1e-4 AND rho < 1 THEN 1 / rho - 1 ELSE 10.0 END AS s FROM rho),
hv AS (SELECT source, (f + m * s) / (n + s) AS rate FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND NOT coalesce(rate > 0.6, false)) AS kept
FROM b LEFT JOIN hv ON b.source = hv.source
"""
