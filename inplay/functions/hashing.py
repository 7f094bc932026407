"""Deterministic uniforms: the same (seed, keys) give the same number on every executor and retry."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

PRIME = 2147483647  # 2^31 - 1
_MULTIPLIERS = (48271, 69621, 16807, 40692)


def uniform(seed: int, *keys: Column) -> Column:
    """U[0, 1) from integer keys: a linear mix, then x^5 (a permutation modulo the prime)."""
    mixed = F.lit(seed).cast("bigint")
    for m, k in zip(_MULTIPLIERS, keys):
        mixed = mixed + F.pmod(k.cast("bigint"), F.lit(PRIME)) * m
    x = mixed % PRIME
    sq = (x * x) % PRIME
    return (((sq * sq) % PRIME) * x) % PRIME / float(PRIME)


def uniform_sql(seed: int, *keys: str) -> str:
    """The same number as a SQL expression."""
    mixed = " + ".join([str(seed)] + [f"(({k}) % {PRIME})::BIGINT * {m}" for m, k in zip(_MULTIPLIERS, keys)])
    x = f"(({mixed}) % {PRIME})"
    return (f"(((((({x} * {x}) % {PRIME}) * (({x} * {x}) % {PRIME})) % {PRIME}) * {x}) % {PRIME}"
            f" / {float(PRIME)}::DOUBLE)")


def id_key(ids: Column, is_numeric: bool) -> Column:
    """An integer for an entity id: itself, or its 64-bit hash."""
    return ids.cast("bigint") if is_numeric else F.xxhash64(ids)


def poisson_cdf(n: int = 10) -> list[float]:
    """P(X <= j) of a Poisson(1) variable for j < n."""
    out, total = [], 0.0
    for j in range(n):
        total += math.exp(-1) / math.factorial(j)
        out.append(total)
    return out


def uniforms(seed: int, keys: np.ndarray, n: int) -> np.ndarray:
    """uniform(seed, key, number) as an array (keys x 0..n-1); keys are not negative."""
    mixed = seed + keys.astype(np.int64)[:, None] % PRIME * _MULTIPLIERS[0] + np.arange(n, dtype=np.int64)[None, :] * _MULTIPLIERS[1]
    x = mixed % PRIME
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME / float(PRIME)


def poisson_weights(seed: int, keys: np.ndarray, n: int) -> np.ndarray:
    """Poisson(1) counts (keys x 0..n-1) by inverse CDF of uniform(seed, key, number); keys lie in [0, PRIME)."""
    return np.searchsorted(poisson_cdf(), uniforms(seed, keys, n), "right")


def poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"(({u}) >= {edge!r}::DOUBLE)::INT" for edge in poisson_cdf()) + ")::BIGINT"
