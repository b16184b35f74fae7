"""Tail probabilities of test statistics, computed from statistics that Spark has already aggregated."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - s, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """One-sided exact test of a 2 x 2 table: chance of at least ``a`` given the margins."""
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    r, s, n = a + b, a + c, a + b + c + d
    whole = lc(n, s)
    return min(1.0, sum(math.exp(lc(r, k) + lc(n - r, s - k) - whole) for k in range(a, min(r, s) + 1) if s - k <= n - r))


def _wrap(fn, arity: int):
    def call(*cols: pd.Series) -> pd.Series:
        return pd.Series([fn(*map(float, row)) if all(pd.notna(v) for v in row) else None for row in zip(*cols)], dtype="float64")

    one = {1: lambda a: call(a), 2: lambda a, b: call(a, b), 3: lambda a, b, c: call(a, b, c), 4: lambda a, b, c, d: call(a, b, c, d)}[arity]
    one.__annotations__ = {k: pd.Series for k in ("a", "b", "c", "d")[:arity]} | {"return": pd.Series}
    return F.pandas_udf(one, T.DoubleType())


normal_p = _wrap(normal_two_sided, 1)
t_p = _wrap(t_two_sided, 2)
chi2_p = _wrap(chi2_tail, 2)
f_p = _wrap(f_tail, 3)
fisher_p = _wrap(lambda a, b, c, d: fisher_greater(int(a), int(b), int(c), int(d)), 4)
