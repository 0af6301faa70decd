"""Tail probabilities of test statistics, as pandas functions for tables of results (a row per test, not per sample)."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 400):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + numerator / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 2000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1 / _TINY
    d = 1 / b
    h = d
    for k in range(1, 2000):
        step = -k * (k - a)
        b += 2
        d = step * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, k: float) -> float:
    return gamma_upper(k / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


@lru_cache(256)
def _rank_sums(doubled: tuple[int, ...]) -> np.ndarray:
    """How many of all sign patterns give each sum of (doubled) ranks."""
    ways = np.zeros(sum(doubled) + 1)
    ways[0] = 1
    for r in doubled:
        ways[r:] = ways[r:] + ways[: len(ways) - r]
    return ways


def signed_rank_exact(ranks: list[float], w_plus: float) -> float:
    """Two-sided p of a signed-rank sum, over all sign patterns of the ranks (which may be tied halves)."""
    doubled = tuple(sorted(round(2 * r) for r in ranks))
    ways = _rank_sums(doubled)
    at = round(2 * w_plus)
    below, above = ways[: at + 1].sum(), ways[at:].sum()
    return float(min(1.0, 2 * min(below, above) / ways.sum()))


def studentized_range_upper(q: float, k: int, df: float) -> float:
    """Upper tail of the studentized range of k means, by numeric integration."""
    if q <= 0:
        return 1.0
    z = np.linspace(-8, 8, 801)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = lambda x: 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))
    base = cdf(z)

    def range_cdf(w: float) -> float:
        return float(k * np.trapezoid(phi * np.clip(base - cdf(z - w), 0, 1) ** (k - 1), z))

    if df > 2000 or math.isinf(df):
        return max(0.0, 1 - range_cdf(q))
    s = np.linspace(1e-3, 1 + 8 / math.sqrt(df), 121)
    log_density = (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(max(0.0, 1 - np.trapezoid(np.exp(log_density) * np.array([range_cdf(q * x) for x in s]), s)))


def _column(f):
    @F.pandas_udf(DoubleType())
    def out(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*map(float, row)) if not any(v is None or pd.isna(v) for v in row) else None for row in zip(*columns, strict=True)], dtype="float64")

    return out


p_normal, p_f, p_chi2, p_t = (_column(f) for f in (normal_two_sided, f_upper, chi2_upper, t_two_sided))


@F.pandas_udf(DoubleType())
def p_studentized_range(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([studentized_range_upper(a, int(b), c) for a, b, c in zip(q, k, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def p_signed_rank(ranks: pd.Series, w_plus: pd.Series) -> pd.Series:
    """Exact p where ranks are given, null otherwise."""
    return pd.Series([signed_rank_exact(list(r), w) if r is not None and len(r) else None for r, w in zip(ranks, w_plus, strict=True)], dtype="float64")
