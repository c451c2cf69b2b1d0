"""Hand-computed values of column functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bilatera.functions import profiles as P
from bilatera.functions import scalars as X


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(float(x)) for x in v]).alias(k)
                                 for k, v in cols.items()])
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("value,want", [("TRUE", True), ("yes", True), ("1", True), ("1.0", False), ("no", False), (1.0, False), (True, True)])
def test_flag(spark, value, want):
    assert one(spark, X.as_flag("c"), c=value) is want


def test_side_variants_disagree_on_letters(spark):
    assert one(spark, X.side_norm("c"), c="L") is None
    assert one(spark, X.side_exact("c"), c="L") == "left"
    assert one(spark, X.side_norm("c"), c=" left breast") == "LEFT"
    assert one(spark, X.side_exact("c"), c="left breast") is None


def test_report_number(spark):
    assert one(spark, X.report_number("c"), c=0.123456789) == 0.12346
    assert one(spark, X.report_number("c"), c=float("nan")) is None
    assert one(spark, X.report_number("c"), c=float("inf")) is None


def test_to_number(spark):
    assert one(spark, X.to_number("c"), c="12.5") == 12.5
    assert one(spark, X.to_number("c"), c="n/a") is None


def savgol(y, window, order):
    """Direct polynomial fits: centre of each window, end windows evaluated at every end point."""
    n, h = len(y), window // 2
    out = np.empty(n)
    for i in range(n):
        s = min(max(i - h, 0), n - window)
        x = np.arange(window) - (i - s)
        out[i] = np.polyval(np.polyfit(x, y[s:s + window], order), 0)
    return out


@pytest.mark.parametrize("n,window", [(5, 0), (6, 0), (7, 7), (8, 7), (9, 9), (10, 9), (11, 11), (30, 11)])
def test_smooth(spark, n, window):
    y = np.random.default_rng(n).normal(size=n)
    want = savgol(y, window, 3) if window else y
    assert np.allclose(one(spark, P.smooth("y"), y=list(y)), want, atol=1e-10)


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.97, 1.0])
@pytest.mark.parametrize("n", [1, 2, 7])
def test_quantile(spark, p, n):
    y = np.random.default_rng(n).normal(size=n)
    assert one(spark, P.quantile(F.col("y"), p), y=list(y)) == pytest.approx(np.quantile(y, p))


def test_interpolate_and_resample(spark):
    q, y, g = [1.0, 2.0, 4.0], [10.0, 20.0, 0.0], [0.0, 1.0, 1.5, 3.0, 4.0, 9.0]
    got = one(spark, P.interpolate(F.col("g"), F.col("q"), F.col("y")), g=g, q=q, y=y)
    assert np.allclose(got, np.interp(g, q, y))
    df = spark.createDataFrame([(q, [10.0, float("nan"), 0.0])], "q array<double>, y array<double>")
    assert np.allclose(df.select(P.resample(1, 4, 7)("q", "y").alias("r")).first()["r"], np.interp(np.linspace(1, 4, 7), [1, 4], [10, 0]))


def test_roi_peak_trapezoid(spark):
    q, y = [1.0, 2.0, 3.0, 4.0], [1.0, 5.0, 2.0, 8.0]
    assert one(spark, P.roi_y("q", "y", 2.0, 3.0), q=q, y=y) == [5.0, 2.0]
    assert one(spark, P.peak_value("q", "y", 1.0, 3.0), q=q, y=y) == 5.0
    assert one(spark, P.peak_value("q", "y", 1.0, 2.0), q=q, y=y) is None
    assert one(spark, P.trapezoid("q", "y"), q=q, y=y) == pytest.approx(np.trapezoid(y, q))
    assert one(spark, P.trapezoid("q", "y"), q=[1.0], y=[2.0]) == 0.0


def test_cosine_masks_and_limits(spark):
    nan = float("nan")
    assert one(spark, P.cosine_distance("a", "b"), a=[1, 2, 3, nan], b=[2, 4, 6, 1]) == pytest.approx(0.0)
    assert one(spark, P.cosine_distance("a", "b"), a=[1, nan, 3], b=[2, 4, 6]) is None
    assert one(spark, P.cosine_distance("a", "b"), a=[0, 0, 0], b=[2, 4, 6]) is None


def test_min_max_constant_profile(spark):
    assert one(spark, P.min_max("y"), y=[3.0, 3.0]) == [0.0, 0.0]
    assert one(spark, P.min_max("y"), y=[1.0, 3.0, 2.0]) == [0.0, 1.0, 0.5]


def test_report_rounding_is_pythons(spark):
    import random

    r = random.Random(0)
    values = [0.015625, 0.046875, -0.015625, 2.675, 1.000005, 0.0, -1e-9, 123456.789012345, 5e15, 1e300, 0.000005, 0.000015]
    values += [r.uniform(-10, 10) for _ in range(500)] + [round(r.uniform(-3, 3), 5) + 5e-6 for _ in range(500)] + [k / 64 for k in range(-200, 200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", X.report_number("v").alias("r")).collect():
        assert row["r"] == round(row["v"], 5)
