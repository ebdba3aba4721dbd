"""Probabilities of test statistics, as vectorised functions over one row per comparison."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            return value
    raise ArithmeticError(f"incomplete beta does not converge at a={a}, b={b}, x={x}")


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@lru_cache(maxsize=64)
def _rank_sum_counts(n: int) -> np.ndarray:
    """Number of sign patterns per positive-rank sum."""
    counts = np.array([1.0])
    for rank in range(1, n + 1):
        grown = np.zeros(len(counts) + rank)
        grown[: len(counts)] += counts
        grown[rank:] += counts
        counts = grown
    return counts


def signed_rank_p(plus: float, n: int, ties: float, zeros: int, alternative: str) -> float:
    """Exact for up to 50 untied differences without zeros, else normal with tie correction."""
    if n == 0:
        return 1.0
    if n <= 50 and ties == 0 and zeros == 0:
        share = _rank_sum_counts(n) / 2.0 ** n
        below, above = share[: int(plus) + 1].sum(), share[int(plus):].sum()
    else:
        spread = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
        z = (plus - n * (n + 1) / 4) / spread if spread > 0 else 0.0
        below, above = _upper(-z), _upper(z)
    return min({"greater": above, "less": below, "two-sided": 2 * min(below, above)}[alternative], 1.0)


# Polynomial coefficients of the published normality test (constant term first).
_C1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_C3 = [0.544, -0.39978, 0.025054, -6.714e-4]
_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
_C6 = [-0.4803, -0.082676, 0.0030302]


def _poly(coefficients, x):
    return sum(c * x ** i for i, c in enumerate(coefficients))


@lru_cache(maxsize=64)
def order_weights(n: int) -> np.ndarray:
    """Weights of the ordered sample in the normality statistic."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total, u = float(m @ m), 1 / math.sqrt(n)
    ends = [_poly(_C1, u) + m[-1] / math.sqrt(total)]
    if n > 5:
        ends.append(_poly(_C2, u) + m[-2] / math.sqrt(total))
    k = len(ends)
    rest = (total - 2 * sum(m[-i] ** 2 for i in range(1, k + 1))) / (1 - 2 * sum(e * e for e in ends))
    weights = m / math.sqrt(rest)
    for i, e in enumerate(ends):
        weights[-1 - i], weights[i] = e, -e
    return weights


def normality_p(w: float, n: int) -> float:
    if n == 3:
        return max(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if y >= gamma:
            return 1e-99
        y, mean, sd = -math.log(gamma - y), _poly(_C3, n), math.exp(_poly(_C4, n))
    else:
        x = math.log(n)
        mean, sd = _poly(_C5, x), math.exp(_poly(_C6, x))
    return _upper((y - mean) / sd)


@F.pandas_udf(T.DoubleType())
def paired_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def wilcoxon_p(plus: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series, alternative: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(a, int(b), c, int(z), e) for a, b, c, z, e in zip(plus, n, ties, zeros, alternative)])


@F.pandas_udf(T.DoubleType())
def order_weight(place: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([order_weights(int(k))[int(i) - 1] for i, k in zip(place, n)])


@F.pandas_udf(T.DoubleType())
def shapiro_p(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([normality_p(a, int(k)) for a, k in zip(w, n)])
