"""Operator 3: language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed byte n-grams (2 to 4 bytes of a word with
its boundary marks), a linear softmax maps the average to languages. Training is stochastic
gradient descent in numpy on a bounded sample of labelled documents, chosen by a hash of id and text.
The bounds are parameters: ``max_docs_per_lang`` documents a language for the ``max_languages`` most
frequent languages, ``spans`` word spans of each document, and of a span longer than
``max_span_chars`` a window of so many characters at a random place. A quarter of the sampled
documents, none of which are trained on, fits the temperature that calibrates the probabilities and
the score below which a text is rejected.

For prediction the embedding and the softmax weights are folded into one table of bucket by
language, so whole texts of any length are scored in bounded blocks.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; a
language equally probable with another goes to the first in name order; labels that are null are
never learned from; with no labelled rows every text is ``und``. Repeated rows are predicted alike;
ids are of any type and may be null. Extra columns stay, the new ones replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, free_name, small_batches, trimmed
from .wordhash import TABLE, blocks, buffers, mix

UNDETERMINED = "und"
MAX_LANGUAGES, MAX_SPAN_CHARS, BLOCK_BYTES = 1000, 1000, 1 << 17
GRAMS = (2, 3, 4)


def _lowered() -> np.ndarray:
    """Per byte: lower-case letters stay, other ASCII marks are a boundary, the rest stays."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] = out[97:123]
    keep = np.zeros(256, dtype=bool)
    keep[97:123] = keep[65:91] = keep[128:] = True
    out[~keep] = 32
    return out


LOWERED = _lowered()


def _grams(padded: np.ndarray, text_of: np.ndarray | None, starts: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place) of the n-grams that begin in the first ``starts`` bytes; ``text_of`` is None for one text."""
    values, space = TABLE[padded], padded == 32
    parts, places = [], []
    for n in GRAMS:
        m = min(len(padded) - n + 1, starts)
        if m <= 0:
            continue
        ok = np.ones(m, dtype=bool) if text_of is None else text_of[:m] == text_of[n - 1 : n - 1 + m]
        if n == 2:
            ok &= ~(space[:m] & space[1 : m + 1])
        for k in range(1, n - 1):
            ok &= ~space[k : m + k]
        at = np.flatnonzero(ok)
        h = values[at].copy()
        for k in range(1, n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + values[at + k]
        parts.append((mix(h + np.uint64(n)) % np.uint64(n_buckets)).astype(np.int64))
        places.append(at)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(places)


def gram_buckets(data: np.ndarray, offsets: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts and, beside each, the index of its text.

    An n-gram may begin or end with a boundary and has none inside.
    """
    n_texts = len(offsets) - 1
    padded = np.full(len(data) + 2 * n_texts, 32, dtype=np.uint8)
    text_of = np.repeat(np.arange(n_texts, dtype=np.int64), np.diff(offsets) + 2)
    padded[np.arange(len(data)) + 2 * np.repeat(np.arange(n_texts), np.diff(offsets)) + 1] = LOWERED[data]
    buckets, places = _grams(padded, text_of, len(padded), n_buckets)
    return buckets, text_of[places]


def long_gram_buckets(data: np.ndarray, n_buckets: int, size: int) -> Iterator[np.ndarray]:
    """The same buckets for one long text, those that begin in ``size`` bytes at a time."""
    padded = np.full(len(data) + 2, 32, dtype=np.uint8)
    padded[1:-1] = LOWERED[data]
    for at in range(0, len(padded), size):
        yield _grams(padded[at : at + size + max(GRAMS) - 1], None, size, n_buckets)[0]


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Calibrated probabilities of each language, a row for each text."""
        data, offsets = buffers(column)
        n, k = len(offsets) - 1, len(self.languages)
        total, count = np.zeros((n, k)), np.zeros(n)
        for at, to in blocks(offsets, BLOCK_BYTES):
            own = data[offsets[at] : offsets[to]]
            if len(own) > BLOCK_BYTES:
                for buckets in long_gram_buckets(own, len(self.table), BLOCK_BYTES):
                    total[at] += self.table[buckets].sum(axis=0)
                    count[at] += len(buckets)
                continue
            buckets, owner = gram_buckets(own, offsets[at : to + 1] - offsets[at], len(self.table))
            for j in range(k):
                total[at:to, j] += np.bincount(owner, self.table[buckets, j], minlength=to - at)
            count[at:to] += np.bincount(owner, minlength=to - at)
        logits = total / np.maximum(count, 1)[:, None] / self.temperature
        logits -= logits.max(axis=1, keepdims=True) if k else 0
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def training_spans(df: DataFrame, max_docs_per_lang: int, spans: int, max_languages: int = MAX_LANGUAGES, max_span_chars: int = MAX_SPAN_CHARS) -> pd.DataFrame:
    """Spans of the sampled documents: (lang, span, part); a document's spans are all of one part."""
    small_batches(df.sparkSession)
    labelled = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("doc_id", "text").alias("seed"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "span": [], "part": []})
    spread = F.pmod(F.xxhash64("seed", F.lit("language")), F.lit(1_000_000))
    shares = df.sparkSession.createDataFrame([(lang, int(min(1.0, 1.1 * max_docs_per_lang / n) * 1_000_000)) for lang, n in counts.items()], "lang string, share long")
    chosen = labelled.join(F.broadcast(shares), "lang").where(spread < F.col("share"))  # a row for each of max_languages

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, lang, seed in zip(batch["text"], batch["lang"], batch["seed"]):
                words, rng, own = text.split(), np.random.RandomState(seed % (1 << 31)), seed % (1 << 62)
                for i in range(spans if words else 0):
                    n = int(rng.choice([2, 5, 12, 40]))
                    at = rng.randint(0, max(1, len(words) - n + 1))
                    span = " ".join(words[at : at + n])
                    at = rng.randint(0, max(1, len(span) - max_span_chars + 1))
                    rows.append((lang, span[at : at + max_span_chars], own % 4, own, i))
            yield pd.DataFrame(rows, columns=["lang", "span", "part", "own", "i"])

    out = chosen.select("text", "lang", "seed").mapInPandas(trimmed(cut), "lang string, span string, part int, own long, i int").toPandas()
    out = out.sort_values(["lang", "own", "i", "span"], kind="stable")
    return out.groupby("lang", sort=True).head(max_docs_per_lang * spans)[["lang", "span", "part"]].reset_index(drop=True)


def train(df: DataFrame, max_docs_per_lang: int = 1000, spans: int = 4, n_buckets: int = 1 << 16, dim: int = 12, epochs: int = 3, rate: float = 0.5, reject_share: float = 0.001, seed: int = 7, max_languages: int = MAX_LANGUAGES, max_span_chars: int = MAX_SPAN_CHARS) -> LanguageModel:
    """Fit on (doc_id, text, lang)."""
    sample = training_spans(df, max_docs_per_lang, spans, max_languages, max_span_chars)
    languages = sorted(sample["lang"].unique())
    if not languages:
        return LanguageModel([], np.zeros((n_buckets, 0)), 1.0, 1.0)
    label = sample["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    data, offsets = buffers(pa.array(sample["span"].tolist(), type=pa.string()))
    parts = []
    for at, to in blocks(offsets, BLOCK_BYTES):
        b, o = gram_buckets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], n_buckets)
        parts.append((b.astype(np.int32), (o + at).astype(np.int32)))
    buckets, owner = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(owner, kind="stable")
    buckets, bounds = buckets[order], np.searchsorted(owner[order], np.arange(len(sample) + 1))
    rng = np.random.RandomState(seed)
    embedding, weights = rng.uniform(-1 / dim, 1 / dim, (n_buckets, dim)), np.zeros((dim, len(languages)))
    fit, seen = np.flatnonzero(sample["part"].to_numpy() != 0), np.zeros(n_buckets, dtype=bool)
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            own = buckets[bounds[i] : bounds[i + 1]]
            done += 1
            if not len(own):
                continue
            lr = rate * (1 - done / (steps + 1))
            hidden = embedding[own].mean(axis=0)
            z = hidden @ weights
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            back = weights @ p
            weights -= lr * np.outer(hidden, p)
            np.subtract.at(embedding, own, lr * back / len(own) * min(len(own), 20))
            seen[own] = True
    table = np.where(seen[:, None], embedding @ weights, 0.0)
    model = LanguageModel(languages, table, 1.0, 0.0)
    held = sample["part"].to_numpy() == 0
    total = np.stack([np.bincount(np.repeat(np.arange(len(sample)), np.diff(bounds)), table[buckets, j], minlength=len(sample)) for j in range(len(languages))], axis=1)
    logits, truth = (total / np.maximum(np.diff(bounds), 1)[:, None])[held], label[held]

    def prob(t: float) -> np.ndarray:
        z = logits / t
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 40))
    model.temperature = float(min(grid, key=lambda t: -np.log(prob(t)[np.arange(len(truth)), truth] + 1e-12).mean())) if len(truth) else 1.0
    best = prob(model.temperature)
    right = best.max(axis=1)[best.argmax(axis=1) == truth] if len(truth) else np.zeros(0)
    chance = 1.0 / len(languages)
    floor = float(np.quantile(right, reject_share)) if len(right) else 0.0
    model.reject_below = min(floor, chance + 0.5 * (1 - chance)) if len(languages) > 1 else 0.0
    return model


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and rejected; columns of those names are replaced."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]

    def judged_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            p = m.scores(texts) if m.languages else np.zeros((len(texts), 1))
            best = p.argmax(axis=1)
            names = np.array(m.languages or [UNDETERMINED], dtype=object)[best]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(p[np.arange(len(p)), best])], ["lang_pred", "score"])

    @F.arrow_udf("lang_pred string, score double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from trimmed(judged_texts)(batches)

    lettered = F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")
    judged, has_letter = free_name(df, "judged"), free_name(df, "lettered")
    out = df.select(*keep, judge(F.col(text)).alias(judged), lettered.alias(has_letter))
    lang = F.when(F.col(has_letter), F.col(f"{judged}.lang_pred")).otherwise(UNDETERMINED)
    score = F.when(F.col(has_letter), F.col(f"{judged}.score")).otherwise(0.0)
    out = out.withColumns({"lang_pred": lang, "score": score})
    out = out.withColumn("rejected", (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < model.reject_below))
    return out.drop(judged, has_letter)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(training_rows(docs))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
