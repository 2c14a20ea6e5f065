"""Tail probabilities for one-row (or per-group) aggregates, as Arrow functions on those few rows."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, f = 1e-300, 1.0, 1.0
    d = 0.0
    for i in range(0, 2000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def gamma_q(s: float, x: float) -> float:
    """Upper regularised incomplete gamma."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * lead
    b = x + 1 - s
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - s)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h * lead


def student_p(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def student_quantile(p: float, df: float) -> float:
    """Positive t with two-sided tail 2(1-p), by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        if student_p(mid, df) > 2 * (1 - p):
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def t_two_sided_p(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([student_p(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)], dtype="float64")

    return run(t, df)


def t_critical(df: Column, level: float = 0.95) -> Column:
    @F.pandas_udf("double")
    def run(df: pd.Series) -> pd.Series:
        return pd.Series([student_quantile(1 - (1 - level) / 2, d) if pd.notna(d) and d > 0 else None for d in df], dtype="float64")

    return run(df)


def chi2_p(stat: Column, dof: Column) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([gamma_q(b / 2.0, a / 2.0) for a, b in zip(s, d)], dtype="float64")

    return run(stat, dof)


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample tail: 2 * sum over k of (-1)^(k-1) exp(-2 k^2 lambda^2), lambda = D sqrt(nm/(n+m))."""
    lam2 = d * d * n * m / (n + m)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam2))
    # below 0.2 the alternating series has not converged and the tail is 1 to ten digits
    return F.when(lam2 < 0.04, 1.0).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))
