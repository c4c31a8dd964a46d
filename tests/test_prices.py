"""Price arithmetic against plain Python."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from closeline.functions import prices as P


def column(spark, values, expr, schema="x double"):
    frame = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in frame.select(expr).collect()]


def test_payout_and_decimal(spark):
    odds = [150.0, -200.0, 0.0, float("nan"), None, 50.0, -99.0, 100.0]
    assert column(spark, odds, P.payout("x")) == [1.5, 0.5, None, None, None, 0.5, 100 / 99, 1.0]
    assert column(spark, odds, P.decimal_price("x")) == [2.5, 1.5, None, None, None, None, None, 2.0]
    assert column(spark, odds[:3], P.ranked_payout("x")) == [1.5, 0.5, -math.inf]


def test_power_fair_solves_the_equation(spark):
    pairs = [(0.55, 0.52), (0.9, 0.2), (0.999, 0.01), (0.5, 0.5), (0.3, 0.4), (1.0, 0.5), (0.7, 0.7)]
    got = [tuple(r) for r in spark.createDataFrame(pairs, "a double, b double").select(P.power_fair("a", "b"), P.power_fair("b", "a")).collect()]
    for (a, b), (fa, fb) in zip(pairs, got):
        if 0 < a < 1 and 0 < b < 1 and a + b > 1:
            assert fa + fb == pytest.approx(1.0, abs=1e-12)
        else:
            assert fa is None and fb is None


def test_normal_cdf(spark):
    xs = [i / 7 for i in range(-70, 71)] + [-40.0, 40.0]
    for x, y in zip(xs, column(spark, xs, P.normal_cdf("x"))):
        assert y == pytest.approx(NormalDist().cdf(x), abs=1e-14)


def worst_price(p, threshold=0.02):
    """The longest list of prices, walked from the shortest payout up."""
    for a in [*range(-400, -100), *range(100, 601)]:
        if p * (1 + (a / 100 if a > 0 else -100 / a)) - 1 >= threshold:
            return a
    return None


def test_bet_down_to(spark):
    ps = [i / 997 for i in range(1, 997)]
    assert column(spark, ps, P.bet_down_to("x")) == [worst_price(p) for p in ps]
    assert column(spark, [None, 0.0, 1.0, float("nan")], P.bet_down_to("x")) == [None] * 4


def test_units(spark):
    rows = [(0.0, 100.0), (0.5, 100.0), (1.0, -150.0), (None, 120.0), (0.9, 250.0), (0.9, 800.0), (0.9, 2000.0), (None, None)]
    frame = spark.createDataFrame(rows, "w double, p double")
    assert [r[0] for r in frame.select(P.units("w", "p")).collect()] == [1.0, 1.6, 2.0, 1.0, 0.6, 0.4, 0.2, 1.0]


def test_wilson_edges(spark):
    low, high = P.wilson(F.col("s"), F.col("n"))
    rows = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (5, 10)], "s long, n long").select(low, high).collect()
    assert tuple(rows[0]) == (0.0, 0.0)
    assert rows[1][0] == pytest.approx(0.0, abs=1e-12) and rows[2][1] == pytest.approx(1.0, abs=1e-12)
    assert rows[3][0] + rows[3][1] == pytest.approx(1.0)
