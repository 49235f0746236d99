"""p-values against numerical integration of the densities and direct sums."""

import math

import pytest
from pyspark.sql import functions as F

from locusframe.functions import distributions as D


def integral(f, a, b, n=40_000):
    h = (b - a) / n
    return h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a + i * h) for i in range(n + 1))


def test_tails_are_integrals():
    for t, df in ((0.3, 3), (2.1, 10), (1.0, 4.5), (4.0, 30)):
        density = lambda x, df=df: math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        assert D.t_p(t, df) == pytest.approx(1 - 2 * integral(density, 0, t), abs=1e-9)
    for x, df in ((1.2, 2), (7.8, 3), (30, 25)):
        density = lambda v, df=df: math.exp((df / 2 - 1) * math.log(v) - v / 2 - df / 2 * math.log(2) - math.lgamma(df / 2)) if v else (0.5 if df == 2 else 0.0)
        assert D.chi2_p(x, df) == pytest.approx(1 - integral(density, 0, x), abs=1e-6)
    assert D.chi2_p(3.0, 2) == pytest.approx(math.exp(-1.5)) and D.f_p(2.5, 2, 8) == pytest.approx((1 + 2 * 2.5 / 8) ** -4)
    assert D.normal_p(1.959963984540054) == pytest.approx(0.05) and D.poisson_tail(3, 2.0) == pytest.approx(1 - math.exp(-2) * 5)


def test_hypergeometric_tail_is_a_sum():
    for k, drawn, hits, total in ((2, 5, 6, 20), (0, 3, 3, 9), (4, 6, 4, 12), (9, 9, 30, 40)):
        expected = sum(math.comb(hits, i) * math.comb(total - hits, drawn - i) for i in range(k, min(drawn, hits) + 1)) / math.comb(total, drawn)
        assert D.hypergeometric_tail(k, drawn, hits, total) == pytest.approx(expected)


def test_columns_keep_nulls(spark):
    x = spark.createDataFrame([(2.0, 5.0), (None, 1.0)], "t double, df double").select(D.column(D.t_p)(F.col("t"), F.col("df")).alias("p"))
    assert [r.p for r in x.collect()] == [pytest.approx(D.t_p(2.0, 5.0)), None]
