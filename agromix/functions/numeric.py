"""Numeric functions: Legendre bases, sequences, and tails of distributions without scipy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["chi2_sf", "f_sf", "legendre", "logspace", "normal_sf", "t_sf2", "log_beta_tail"]


def logspace(n: int, start: float, end: float) -> list[float]:
    """n values from start to end, evenly spaced on the log scale."""
    return [float(x) for x in np.exp(np.linspace(math.log(start), math.log(end), n))]


def legendre(df: DataFrame, x: str, n: int = 1, low: float = -1.0, high: float = 1.0, intercept: bool = True, intercept1: bool = False) -> DataFrame:
    """Normalised Legendre polynomials of x, scaled from its range to [low, high], as columns leg0..legn."""
    a, b = df.agg(F.min(x), F.max(x)).first()
    span = (b - a) if a is not None and b > a else 1
    z: Column = low + (high - low) * (F.col(x).cast("double") - F.lit(float(a or 0))) / F.lit(float(span))
    p = [F.lit(1.0), z]
    for k in range(2, n + 1):
        p.append(((2 * k - 1) * z * p[k - 1] - (k - 1) * p[k - 2]) / k)
    more = math.sqrt(2) if intercept1 else 1.0
    return df.withColumns({f"leg{k}": F.lit(math.sqrt((2 * k + 1) / 2) * more) * p[k] for k in range(0 if intercept else 1, n + 1)})


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 + up * d, 1 + up / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        h *= d * c
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 + down * d, 1 + down / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def log_beta_tail(a: float, b: float, x: float) -> float:
    """Natural logarithm of the regularised incomplete beta function I_x(a, b); stays finite far below the smallest float."""
    if x <= 0:
        return -math.inf
    if x >= 1:
        return 0.0
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return front + math.log(_beta_fraction(a, b, x) / a)
    return math.log1p(-min(math.exp(front) * _beta_fraction(b, a, 1 - x) / b, 1 - 1e-16))


def f_sf(f: float, df1: float, df2: float) -> float:
    """Upper tail of F."""
    return math.exp(log_beta_tail(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))) if f > 0 else 1.0


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return f_sf(t * t, 1, df)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-squared: the regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d, c = an * d + b, b + an / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h
