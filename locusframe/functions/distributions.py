"""p-values and other special functions of statistics as Arrow functions, evaluated a batch at a time."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction, on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h / a


def hypergeometric_tail(k: int, drawn: int, hits: int, total: int) -> float:
    """Chance of k or more hits among `drawn` of `total` items of which `hits` are."""
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    low, high = max(k, drawn + hits - total, 0), min(drawn, hits)
    return min(1.0, sum(math.exp(choose(hits, i) + choose(total - hits, drawn - i) - choose(total, drawn)) for i in range(low, high + 1)))


def t_p(t: float, df: float) -> float:
    return beta_lower(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    return beta_lower(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_p(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def poisson_tail(k: int, rate: float) -> float:
    """Chance of k or more events."""
    return 1 - gamma_upper(k, rate) if k > 0 else 1.0


def column(f: Callable[..., float]):  # noqa: ANN201
    """f as a function of columns; null where an argument is."""

    @F.pandas_udf("double")
    def run(*args: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*args, strict=True)], dtype="float64")

    return run
