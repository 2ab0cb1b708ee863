"""Logarithm of the gamma function and the inverse of the normal distribution as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 8, taken back by the recurrence (error under 1e-12)."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0))) + 1 / (1188 * F.pow(y, F.lit(9.0)))
    product = x * (x + 1.0) * (x + 2.0) * (x + 3.0) * (x + 4.0) * (x + 5.0) * (x + 6.0) * (x + 7.0)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


#: Coefficients of Acklam's rational approximation. Fixed values.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]:.15e}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c:.15e})"
    return out


def normal_quantile_sql(p: str) -> str:
    """The z below which a share ``p`` (strictly between 0 and 1) of the normal distribution lies, as SQL (relative error 1.2e-9).

    Every number is a double (written with an exponent), so that two engines compute the same.
    """
    centre = f"({p} - 5e-1)"
    low, high = f"sqrt(-2e0 * ln({p}))", f"sqrt(-2e0 * ln(1e0 - {p}))"
    middle = f"{_poly(_A, f'({centre} * {centre})')} * {centre} / {_poly(_B, f'({centre} * {centre})')}"
    return f"CASE WHEN {p} < 2.425e-2 THEN {_poly(_C, low)} / {_poly(_D, low)} WHEN {p} > 9.7575e-1 THEN -{_poly(_C, high)} / {_poly(_D, high)} ELSE {middle} END"
