"""Baum-Welch counts of long texts against a plain recursion over the whole text."""

import numpy as np

from embergrid.llm import hmm_lm


def plain(texts, model):
    k = len(model.start)
    start, moves, emit, loglik = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit), 0.0
    for text in texts:
        alpha, scale = [], []
        for t, s in enumerate(text):
            a = (alpha[-1] @ model.move if t else model.start) * model.emit[s]
            scale.append(a.sum())
            alpha.append(a / a.sum())
        beta = np.ones(k)
        for t in range(len(text) - 1, -1, -1):
            emit[text[t]] += alpha[t] * beta
            if t:
                weighted = beta * model.emit[text[t]] / scale[t]
                moves += np.outer(alpha[t - 1], weighted) * model.move
                beta = model.move @ weighted
        start += alpha[0] * beta
        loglik += np.log(scale).sum()
    return start, moves, emit, loglik


def test_expected_counts_cross_segments():
    rng = np.random.RandomState(5)
    k, v, n = 3, 11, hmm_lm.SEGMENT
    model = hmm_lm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), size=k), rng.dirichlet(np.full(v, 0.3), size=k).T + 1e-6)
    texts = [rng.randint(0, v, size=s) for s in (1, n - 1, n, n + 1, 2 * n, 7 * n + 5, 30 * n, 3, 2 * n + 1)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    got = hmm_lm.expected_counts(np.concatenate(texts), bounds, model)
    for a, b in zip(got, plain(texts, model)):
        np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-8)
    assert np.isclose(got[1].sum(), sum(len(x) - 1 for x in texts))


def test_expected_counts_without_texts():
    model = hmm_lm.Model(np.full(2, 0.5), np.full((2, 2), 0.5), np.full((3, 2), 1 / 3))
    assert [np.sum(x) for x in hmm_lm.expected_counts(np.zeros(0, np.int64), np.zeros(1, np.int64), model)] == [0, 0, 0, 0]
