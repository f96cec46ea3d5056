"""Normal and t distributions without scipy, and their use in pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: 0.975 quantile of the normal distribution.
Z975 = 1.959963984540054


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float, rest: float | None = None) -> float:
    """The regularised incomplete beta function. rest is 1 - x where the caller has it without loss: of an x near 1 the difference keeps few digits or none."""
    rest = 1 - x if rest is None else rest
    if x <= 0 or rest <= 0:
        return float(rest <= 0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * (math.log(x) if x < 0.5 else math.log1p(-rest)) + b * math.log(rest))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, rest) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if math.isnan(t) or df <= 0:
        return math.nan
    return 0.0 if math.isinf(t) else beta_inc(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    """The p quantile of the t distribution, by bisection."""
    if df <= 0 or not 0 < p < 1:
        return math.nan
    if p < 0.5:
        return -t_ppf(1 - p, df)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) / 2 > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) / 2 > 1 - p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([np.nan if pd.isna(a) or pd.isna(b) else t_two_sided(float(a), float(b)) for a, b in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def z_p_value(z: pd.Series) -> pd.Series:
    return pd.Series([np.nan if pd.isna(a) else normal_two_sided(float(a)) for a in z])


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([np.nan if pd.isna(b) else t_ppf(float(a), float(b)) for a, b in zip(p, df, strict=True)])
