"""Tail probabilities for test results.

Spark SQL has neither the error function nor Student's t. These functions run on
result tables, one row per compared pair of models, never on the paired rows.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# send these functions with the query, so that workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXACT_RANK_ROWS = 1_000  # largest sample whose rank sums can be counted exactly
SERIES_DF = 1_000  # from here on the t tail is integrated
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(20)


def normal_two_sided(z: float) -> float:
    """P(|Z| >= |z|) for a standard normal Z."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"incomplete beta function of {a}, {b}, {x} has not converged")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _t_tails(t: float, df: float) -> float:
    """P(|T| >= |t|) for large ``df``, by integration.

    With v = sqrt(df log(1 + u^2 / df)) the density is nearly normal in v for every ``df``,
    and no term is a difference of large numbers.
    """
    a = df / 2.0
    start = math.sqrt(df * math.log1p(t * t / df))
    reach = min(9.5, 45.0 / max(start, 1e-9))
    edges = np.linspace(start, start + reach, 33)
    half = (edges[1:] - edges[:-1])[:, None] / 2
    v = (edges[1:] + edges[:-1])[:, None] / 2 + half * _NODES
    ratio = v / np.sqrt(df * np.expm1(v * v / df))
    # relative to the height at the start, which may be far below the smallest number
    fall = np.exp(-(1.0 - 1.0 / df) / 2 * (v * v - start * start))
    area = float((half * _WEIGHTS * fall * ratio).sum())
    # log gamma(a + 1/2) - log gamma(a) - log(a) / 2
    scale = -1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)
    return min(1.0, 2.0 * area * math.exp(scale - (1.0 - 1.0 / df) / 2 * start * start) / math.sqrt(2.0 * math.pi))


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    if math.isinf(t):
        return 0.0
    if df >= SERIES_DF:
        return _t_tails(t, df)
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(upper_tail: float, df: float) -> float:
    """The t with P(T >= t) = ``upper_tail``, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) / 2.0 > upper_tail:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if mid in (low, high):
            break
        if t_two_sided(mid, df) / 2.0 > upper_tail:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def rank_sum_two_sided(statistic: float, n: int) -> float:
    """Exact two-sided probability of a signed-rank sum as small, without ties or zeros."""
    if n > EXACT_RANK_ROWS:
        raise ValueError(f"exact rank sums of {n} pairs, at most {EXACT_RANK_ROWS} can be counted")
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[: len(ways) - r]
    return min(1.0, 2.0 * float(ways[: int(statistic) + 1].sum()) / 2.0**n)


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return z.map(normal_two_sided, na_action="ignore").astype("float64")


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) if pd.notna(a) else None for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_upper(tail: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(a, b) if b > 0 else None for a, b in zip(tail, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _rank_sum_p(statistic: pd.Series, n: pd.Series) -> pd.Series:
    exact = [rank_sum_two_sided(s, int(k)) if k > 0 else None for s, k in zip(statistic, n)]
    return pd.Series(exact, dtype="float64")


def normal_p_value(z: Column) -> Column:
    return _normal_p(z)


def t_p_value(t: Column, df: Column) -> Column:
    return _t_p(t, df.cast("double"))


def t_upper_quantile(tail: Column, df: Column) -> Column:
    return _t_upper(tail, df.cast("double"))


def rank_sum_p_value(statistic: Column, n: Column) -> Column:
    return _rank_sum_p(statistic, n)
