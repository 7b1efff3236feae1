"""Small special-function helpers for p-values (no scipy in the image).

They run inside Arrow-batched pandas UDFs over result rows (one row per test),
never over data rows.

* regularized incomplete beta I_x(a, b): continued fraction (modified Lentz),
  the textbook method (Press et al., Numerical Recipes §6.4);
* Student-t two-sided p:  I_{df/(df+t²)}(df/2, 1/2);
* F upper tail p:         I_{d2/(d2+d1·F)}(d2/2, d1/2);
* normal CDF / quantile from the standard library.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_N01 = NormalDist()


def _betacf(a: float, b: float, x: float, max_iter: int = 500, eps: float = 1e-15) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x is None or a is None or b is None or math.isnan(x):
        return float("nan")
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or df <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_upper_p(f: float, d1: float, d2: float) -> float:
    if f is None or d1 is None or d2 is None or d1 <= 0 or d2 <= 0 or math.isnan(f):
        return float("nan")
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def norm_cdf(x: float) -> float:
    return _N01.cdf(x)


def norm_ppf(p: float) -> float:
    return _N01.inv_cdf(p)


def _vec(fn, *series: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in vals)
                      else fn(*vals) for vals in zip(*series)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student-t p-value (vectorised over result rows)."""
    return _vec(lambda a, b: t_two_sided_p(float(a), float(b)), t, df)


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail F p-value (vectorised over result rows)."""
    return _vec(lambda a, b, c: f_upper_p(float(a), float(b), float(c)), f, d1, d2)


__all__ = ["betainc", "t_two_sided_p", "f_upper_p", "norm_cdf", "norm_ppf", "t_pvalue", "f_pvalue", "np"]
