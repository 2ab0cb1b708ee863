"""Distribution functions as column expressions, for aggregated rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(z: Column) -> Column:
    """Normal distribution by a five-term rational approximation (error under 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return float("nan") if not df > 0 or math.isnan(t) else beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return float("nan") if not (d1 > 0 and d2 > 0 and f >= 0) else beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic. Runs once per aggregated row."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(d) else t_two_sided(x, d) for x, d in zip(t, df, strict=True)], dtype="float64")

    return p(t, df)


def _by_row(f, *columns: Column) -> Column:
    """``f`` of each aggregated row; null where an argument is."""

    @F.pandas_udf("double")
    def values(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else f(*row) for row in frame.itertuples(index=False)], dtype="float64")

    return values(F.struct(*[c.cast("double") for c in columns]))


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    """Upper p of an F statistic. Runs once per aggregated row."""
    return _by_row(f_upper, f, d1, d2)


def binomial_upper(hits: float, n: float) -> float:
    """Chance of ``hits`` or more of ``n`` even draws."""
    return 1.0 if hits <= 0 else beta_cdf(hits, n - hits + 1, 0.5)


def binomial_p_value(hits: Column, n: Column) -> Column:
    """One-sided p of a count of even draws. Runs once per aggregated row."""
    return _by_row(binomial_upper, hits, n)


def t_quantile(level: float, df: float) -> float:
    """The t that a two-sided interval of ``level`` reaches, by halving."""
    if not df > 0:
        return float("nan")
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > 1 - level:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 1 - level else (lo, mid)
    return (lo + hi) / 2


def t_reach(level: float, df: Column) -> Column:
    """Half width, in standard errors, of a mean's interval. Runs once per aggregated row."""
    return _by_row(lambda d: t_quantile(level, d), df)
