"""Operator 4: a hidden Markov language model, and a unigram base, over whole texts.

Word counts of all training tokens come first (words are 64-bit hashes, summed per batch before
the shuffle). The most frequent ``symbols`` words are the model's observations besides the end
token and one symbol for all other words; other words share that symbol's probability by their
own smoothed counts. Baum-Welch runs over all training texts in each of ``rounds`` passes: every
task sums the expected counts of its texts, the sums are added up per symbol in a shuffle, and
only the parameters (states x symbols) reach the driver. Training runs segments of ``SEGMENT``
tokens side by side and carries the states over their bounds both ways, so its counts are those of
whole texts; scoring runs the scaled forward recursion over the whole text, so the score is
the exact log10 probability of the text under the model.

The base's counts of the ``head`` most frequent words are broadcast (bounded); all rarer words of
a text are looked up by a join with the full count table.

Defined results: a null or empty text is its end token alone; words never seen have count 0 in
both models and get the smoothed rest; without training texts the counts are 0, the base is
log10 of 0.5 / (0.5 (V + 1)) a token. Repeated rows are scored row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, trimmed, written
from .wordhash import batch_words

END, OTHER = 0, 1
STATES, SYMBOLS, HEAD, ROUNDS, SEGMENT = 8, 16_384, 262_144, 3, 48
LN10 = float(np.log(10.0))


@dataclass
class Words:
    """Sorted hashes and counts of the most frequent words; ``symbol`` is OTHER beyond the observations."""

    hashes: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    total: int
    distinct: int
    ends: int
    rest_tokens: int  # training tokens and distinct words outside the observations
    rest_distinct: int

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, known) of word hashes in the head."""
        if not len(self.hashes):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return at, self.hashes[at] == words

    def symbols(self, words: np.ndarray) -> np.ndarray:
        at, known = self.find(words)
        return np.where(known, self.symbol[at], OTHER) if len(self.hashes) else np.full(len(words), OTHER)

    @property
    def n_symbols(self) -> int:
        return 2 + int((self.symbol > OTHER).sum())


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def word_counts(train: DataFrame) -> DataFrame:
    """(h, n) of all words of the training texts, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [w for _, w, _ in batch_words(batch.column(0))]
            h, n = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return written(train.select("text").mapInArrow(trimmed(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")


def frequent_words(counts: DataFrame, ends: int, head: int, symbols: int) -> Words:
    stats = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "h").limit(head).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    rank = np.lexsort((h.view(np.int64), -n))
    symbol = np.full(len(h), OTHER, dtype=np.int64)
    symbol[rank[:symbols]] = np.arange(min(symbols, len(h))) + 2
    order = np.argsort(h)
    seen = symbol > OTHER
    return Words(h[order], n[order], symbol[order], (stats["n"] or 0) + ends, stats["v"] + (ends > 0), ends, (stats["n"] or 0) - int(n[seen].sum()), stats["v"] - int(seen.sum()))


def first_model(words: Words, states: int, seed: int) -> Model:
    """Sticky states; emissions near the counts, each state perturbed its own way."""
    rng = np.random.RandomState(seed)
    n = np.zeros(words.n_symbols)
    n[END], n[OTHER] = words.ends, words.rest_tokens
    seen = words.symbol > OTHER
    n[words.symbol[seen]] = words.counts[seen]
    emit = (n[:, None] + 0.5) * rng.gamma(0.7, size=(len(n), states)) + 1e-3
    emit[END] = n[END] + 0.5
    move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * 0.9
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _symbol_texts(column: pa.Array, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, symbols with an END after each text, offsets) in blocks."""
    for first, hashes, bounds in batch_words(column):
        n = len(bounds) - 1
        out = np.full(len(hashes) + n, END, dtype=np.int64)
        out[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(bounds))] = words.symbols(hashes)
        yield first, out, bounds + np.arange(n + 1)


def _carried(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, fresh: np.ndarray, at: np.ndarray, pieces: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(state before, beta at the last token) of each segment, exact over whole texts.

    A later segment is a states x states matrix; the matrices of a text are chained both ways.
    ``at`` is the row of each segment in text order; rows are by falling size.
    """
    k = len(model.start)
    before, last = np.zeros((len(begin), k)), np.ones((len(begin), k))
    many = np.argsort(-pieces, kind="stable")
    firsts = (np.cumsum(pieces) - pieces)[many]
    cuts = np.searchsorted(-pieces[many], -np.arange(pieces.max(initial=0)), "left")  # texts of more than j segments
    if len(cuts) < 2:
        return before, last
    own = begin[at[firsts[: cuts[1]]]]  # first segments that others follow are full
    state = model.start * model.emit[symbols[own]]
    for t in range(1, SEGMENT):
        state = (state / state.sum(axis=1, keepdims=True)) @ model.move * model.emit[symbols[own + t]]
    state /= state.sum(axis=1, keepdims=True)
    later = np.flatnonzero(~fresh)
    chain = np.tile(np.eye(k), (len(later), 1, 1))
    for t in range(int(size[later].max())):
        a = int(np.searchsorted(-size[later], -t, "left"))
        chain[:a] = (chain[:a].reshape(-1, k) @ model.move).reshape(a, k, k) * model.emit[symbols[begin[later[:a]] + t]][:, None]
        if t % 8 == 7:
            chain[:a] /= chain[:a].sum(axis=(1, 2), keepdims=True)
    row = np.cumsum(~fresh) - 1
    for j in range(1, len(cuts)):
        own = at[firsts[: cuts[j]] + j]
        before[own] = state[: cuts[j]]
        state = np.einsum("ai,aij->aj", before[own], chain[row[own]])
        state /= state.sum(axis=1, keepdims=True)
    for j in range(len(cuts) - 1, 0, -1):
        own = at[firsts[: cuts[j]] + j]
        back = np.einsum("aij,aj->ai", chain[row[own]], last[own])
        last[at[firsts[: cuts[j]] + j - 1]] = back / (before[own] * back).sum(axis=1, keepdims=True)
    return before, last


def expected_counts(symbols: np.ndarray, bounds: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected start, move and emission counts of whole texts, and the log likelihood; segments run side by side."""
    k = len(model.start)
    lengths = np.diff(bounds)
    pieces = -(-lengths // SEGMENT)
    begin = np.repeat(bounds[:-1], pieces) + SEGMENT * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.minimum(begin + SEGMENT, np.repeat(bounds[1:], pieces))
    fresh = np.isin(begin, bounds[:-1])
    order = np.argsort(-(end - begin), kind="stable")
    begin, size, fresh = begin[order], (end - begin)[order], fresh[order]
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    before, last = _carried(symbols, begin, size, fresh, at, pieces, model)
    steps = int(size.max()) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(steps)]
    prior = np.where(fresh[:, None], model.start, before @ model.move)
    alphas, scales, seen, loglik = [], [], [], 0.0
    state = prior
    for t in range(steps):
        a = active[t]
        s = symbols[begin[:a] + t]
        state = (state[:a] @ model.move if t else state[:a]) * model.emit[s]
        c = state.sum(axis=1, keepdims=True)
        state = state / c
        alphas.append(state)
        scales.append(c)
        seen.append(s)
        loglik += float(np.log(c).sum())
    moves = np.zeros((k, k))
    gammas = [None] * steps
    beta = np.ones((0, k))
    for t in range(steps - 1, -1, -1):
        a = active[t]
        own = last[:a].copy()
        if t + 1 < steps:
            b = active[t + 1]
            weighted = beta * model.emit[seen[t + 1]] / scales[t + 1]
            moves += (alphas[t][:b].T @ weighted) * model.move
            own[:b] = weighted @ model.move.T
        beta = own
        gammas[t] = alphas[t] * beta
    if steps:  # from the last token of a segment to the next segment; ``before`` is 0 without one
        moves += (before.T @ (beta * model.emit[seen[0]] / scales[0])) * model.move
    emit = np.zeros_like(model.emit)
    if steps:
        every, weight = np.concatenate(seen), np.concatenate(gammas)
        for j in range(k):
            emit[:, j] = np.bincount(every, weight[:, j], minlength=len(emit))
    start = gammas[0][fresh[: len(gammas[0])]].sum(axis=0) if steps else np.zeros(k)
    return start, moves, emit, loglik


def baum_welch_pass(train: DataFrame, words: Words, model: Model) -> tuple[Model, float]:
    """One pass over all training texts: rows (kind or symbol, counts by state), added up in a shuffle."""
    shared = train.sparkSession.sparkContext.broadcast((words, model))
    k = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value
        start, moves, emit, loglik = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit), 0.0
        for batch in batches:
            for _, symbols, bounds in _symbol_texts(batch.column(0), words):
                a, b, c, d = expected_counts(symbols, bounds, model)
                start, moves, emit, loglik = start + a, moves + b, emit + c, loglik + d
        used = np.flatnonzero(emit.sum(axis=1))
        keys = np.concatenate([[-1, -2], -3 - np.arange(k), used])
        values = np.concatenate([[start], [np.full(k, loglik / k)], moves, emit[used]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(values[:, j]) for j in range(k)]], names=["key", *[f"c{j}" for j in range(k)]])

    schema = "key long, " + ", ".join(f"c{j} double" for j in range(k))
    summed = train.select("text").mapInArrow(trimmed(run), schema).groupBy("key").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(k)]).toArrow()
    keys = summed.column("key").to_numpy()
    values = np.stack([summed.column(f"c{j}").to_numpy() for j in range(k)], axis=1) if len(keys) else np.zeros((0, k))
    by = dict(zip(keys.tolist(), values))
    emit = np.zeros_like(model.emit)
    emit[keys[keys >= 0]] = values[keys >= 0]
    share = emit.sum(axis=1, keepdims=True) / max(emit.sum(), 1e-300)
    emit = emit + 1.0 * share + 1e-4  # pulled towards the shared distribution; nothing is impossible
    moves = np.stack([by.get(-3 - i, np.zeros(k)) for i in range(k)]) + 1e-2
    start = by.get(-1, np.zeros(k)) + 1e-2
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)), float(by.get(-2, np.zeros(k)).sum())


def train_model(train: DataFrame, states: int = STATES, symbols: int = SYMBOLS, head: int = HEAD, rounds: int = ROUNDS, seed: int = 11) -> tuple[DataFrame, Words, Model]:
    counts = word_counts(train)
    words = frequent_words(counts, train.count(), head, symbols)
    model = first_model(words, states, seed)
    for _ in range(rounds):
        model, _ = baum_welch_pass(train, words, model)
    return counts, words, model


def forward(symbols: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """ln probability of each text by the scaled forward recursion, all texts step by step."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    begin, size = bounds[:-1][order], size[order]
    out = np.zeros(len(size))
    state = np.tile(model.start, (len(size), 1))
    steps = int(size.max()) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")
    for t in range(steps):
        a = int(active[t])
        state = (state[:a] @ model.move if t else state[:a]) * model.emit[symbols[begin[:a] + t]]
        c = state.sum(axis=1)
        state /= c[:, None]
        out[:a] += np.log(c)
    back = np.empty(len(size))
    back[order] = out
    return back


def _log_base(n, words: Words):
    return np.log10((n + 0.5) / (words.total + 0.5 * (words.distinct + 1)))


def _log_rest(n, words: Words):
    """log10 share of a word among those outside the observations."""
    return np.log10((n + 0.5) / (words.rest_tokens + 0.5 * (words.rest_distinct + 1)))


def score(docs: DataFrame, counts: DataFrame, words: Words, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """Per row: ``keys``, n_tokens, n_known, train_tokens, base_score and score."""
    shared = docs.sparkSession.sparkContext.broadcast((words, model))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys) + ", row long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, model = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            tokens, known, base, total = np.ones(n, np.int64), np.full(n, int(words.ends > 0)), np.full(n, float(_log_base(words.ends, words))), np.zeros(n)
            rare, times = [np.zeros(0, np.uint64)] * n, [np.zeros(0, np.int64)] * n
            texts, owners = [], []
            for first, hashes, bounds in batch_words(batch.column(len(keys))):
                own = len(bounds) - 1
                doc = np.repeat(np.arange(own), np.diff(bounds))
                at, found = words.find(hashes)
                count = words.counts[at[found]]
                tokens[first : first + own] += np.diff(bounds)
                known[first : first + own] += np.bincount(doc[found], minlength=own)
                base[first : first + own] += np.bincount(doc[found], _log_base(count, words), minlength=own)
                symbol = np.full(len(hashes), OTHER, dtype=np.int64)
                symbol[found] = words.symbol[at[found]]
                rest = found & (symbol == OTHER)
                total[first : first + own] += np.bincount(doc[rest], _log_rest(words.counts[at[rest]], words), minlength=own)
                missing = np.flatnonzero(~found)
                cuts = np.searchsorted(doc[missing], np.arange(own + 1))
                for i in np.flatnonzero(np.diff(cuts)):
                    rare[first + i], times[first + i] = np.unique(hashes[missing[cuts[i] : cuts[i + 1]]], return_counts=True)
                out = np.full(len(hashes) + own, END, dtype=np.int64)
                out[np.arange(len(hashes)) + doc] = symbol
                texts.append(out)
                owners.append(np.diff(bounds) + 1)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(owners))]) if owners else np.zeros(1, np.int64)
            total += forward(np.concatenate(texts) if texts else np.zeros(0, np.int64), bounds, model) / LN10
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rare])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0, x[0].dtype)]).view(np.int64))) if n else pa.array([], pa.list_(pa.int64())) for x in (rare, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], pa.array(row + np.arange(n)), pa.array(tokens), pa.array(known), pa.array(base), pa.array(total), *lists], names=[*keys, "row", "n_tokens", "n_known", "base", "score", "rare", "times"])
            row += n

    scored = written(docs.select(*keys, text).mapInArrow(trimmed(run), schema), "scored")
    least = int(words.counts.min()) if len(words.counts) else 0
    tail = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("k"))
    seen = tail.join(counts.where(F.col("n") <= least), "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    log_base = F.log10((F.col("n") + 0.5) / (words.total + 0.5 * (words.distinct + 1)))
    log_rest = F.log10((F.col("n") + 0.5) / (words.rest_tokens + 0.5 * (words.rest_distinct + 1)))
    sums = seen.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * log_base).alias("b"), F.sum(F.col("k") * log_rest).alias("s"))
    out = scored.drop("rare", "times").join(sums, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        *keys,
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )


def op4_hmm_lm(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counts, words, model = train_model(docs.where(fold(F.col("doc_id"), 5) != 1).select("text"))
    out = score(docs, counts, words, model, ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
