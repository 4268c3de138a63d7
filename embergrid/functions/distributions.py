"""Attribute sampling: numpy-exact on the driver, or column expressions where exactness isn't needed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def sample(rng: np.random.RandomState, n: int, distribution: str, dtype: str = "float", low=0, high=1, loc=0.0, scale=1.0, lam=1.0, min_=0.0, max_=1.0, reciprocal: bool = False) -> np.ndarray:
    """``n`` values; integer uniform bounds are inclusive, ``customized`` is u * (max - min) + min."""
    if distribution == "uniform":
        if dtype == "bool":
            raise ValueError("uniform has no bool values")
        return rng.randint(int(low), int(high) + 1, n) if dtype == "int" else rng.uniform(low, high, n)
    if distribution == "customized":
        if not min_ < max_:
            raise ValueError("min must be below max")
        values = rng.uniform(0.0, 1.0, n) * (max_ - min_) + min_
    elif distribution == "normal":
        values = rng.normal(loc, scale, n)
    elif distribution == "exponential":
        values = rng.exponential(scale, n)
    elif distribution == "poisson":
        values = rng.poisson(1 / lam if reciprocal else lam, n)
    else:
        raise ValueError(f"unknown distribution {distribution!r}")
    return {"int": lambda v: v.astype(np.int64), "float": lambda v: v.astype(float), "bool": lambda v: v.astype(bool)}[dtype](np.asarray(values))


def sample_column(distribution: str, seed: int, low: float = 0.0, high: float = 1.0, loc: float = 0.0, scale: float = 1.0) -> Column:
    """A seeded random column for large tables."""
    if distribution == "uniform":
        return F.rand(seed) * (high - low) + low
    if distribution == "normal":
        return F.randn(seed) * scale + loc
    if distribution == "exponential":
        return -F.log(1 - F.rand(seed)) * scale
    raise ValueError(f"no column form of {distribution!r}")
