"""Tail probabilities as vectorised UDFs over (already aggregated) statistics."""

import itertools
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta integral (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in itertools.count(1):  # some sqrt(a + b) terms are needed
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if not abs(d * c - 1.0) > 1e-15:  # also ends on a NaN
            break
    return h


def _stirling_rest(z: float) -> float:
    return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)


def _beta_front(a: float, b: float, x: float) -> float:
    """x^a (1-x)^b / B(a, b). Large arguments go by Stirling's formula, in which the large
    logarithms cancel before they are rounded."""
    if min(a, b) < 10:
        return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                        + a * math.log(x) + b * math.log1p(-x))
    n = a + b
    log = a * math.log1p((x * n - a) / a) + b * math.log1p((a - x * n) / b)
    rest = _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b)
    return math.sqrt(a * b / (2 * math.pi * n)) * math.exp(log + rest)


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = _beta_front(a, b, x)
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def binom_upper(k: int, n: int, p: float) -> float:
    """P(X >= k) for X ~ Binomial(n, p)."""
    if k <= 0:
        return 1.0
    return beta_cdf(k, n - k + 1, p) if k <= n else 0.0


@F.pandas_udf(DoubleType())
def t_test_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & (df > 0)
    return pd.Series([t_two_sided(a, b) if g else None for a, b, g in zip(t, df, ok)],
                     dtype="float64")


@F.pandas_udf(DoubleType())
def binomial_pvalue(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binom_upper(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)],
                     dtype="float64")
