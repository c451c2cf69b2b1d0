"""Resampling by axis groups against one interpolation per profile, and the row-local calibration metrics on odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bilatera.functions import resampling as R
from bilatera.operators import calibration

PROFILES = "vec_id long, session_uid string, data_batch string, file_name string, q_range array<double>, radial_profile_data array<double>"


def one(grid, q, y, scaled):
    if q is None or y is None or len(q) != len(y):
        return None
    q, y = np.array(q, float), np.array(y, float)
    ok = np.isfinite(q) & np.isfinite(y)
    if not ok.any():
        return None
    out = np.interp(grid, q[ok], y[ok])
    if scaled:
        out = out - out.min()
        out = out / out.max() if out.max() > 0 else out
    return out


def odd_profiles(n=400):
    rng = np.random.default_rng(4)
    axes = [np.linspace(2, 23, 40), np.sort(rng.random(40)) * 20 + 2, np.linspace(5, 9, 7), np.array([3.0]), np.array([1.0, 1.0, 2.0])]
    rows = []
    for i in range(n):
        q = axes[i % len(axes)].copy()
        y = rng.random(len(q)) * 5
        if i % 7 == 3:
            y[rng.integers(len(y))] = np.nan
        if i % 11 == 5:
            q[rng.integers(len(q))] = np.inf
        if i % 13 == 6:
            y[:] = 1.0
        rows.append(([float(v) for v in q], [None if i % 17 == 8 and k == 0 else float(v) for k, v in enumerate(y)]))
    return rows + [(None, [1.0]), ([1.0], None), ([], []), ([1.0, 2.0], [1.0]), ([1.0], [math.nan])]


@pytest.mark.parametrize("scaled", [False, True])
def test_same_as_one_by_one(spark, scaled):
    rows = odd_profiles()
    df = spark.createDataFrame([(i, q, y) for i, (q, y) in enumerate(rows)], "i int, q array<double>, y array<double>").repartition(3)
    got = {r["i"]: r["v"] for r in df.select("i", R.resample(1.0, 24.0, 61, scaled=scaled)("q", "y").alias("v")).collect()}
    grid = np.linspace(1.0, 24.0, 61)
    for i, (q, y) in enumerate(rows):
        want = one(grid, q, [math.nan if v is None else v for v in y] if y is not None else None, scaled)
        assert (got[i] is None) == (want is None), i
        if want is not None and len(set(q)) == len(q):
            assert np.allclose(got[i], want, atol=1e-12), i


def test_blocks_and_slices():
    """Small blocks and a sliced batch give the same values."""
    rows = odd_profiles(60)
    q, y = (pa.array([r[k] for r in rows], pa.list_(pa.float64())) for k in (0, 1))
    grid = np.linspace(2.0, 23.0, 30)
    whole = {int(i): v for at, values in R.on_grid(q, y, grid) for i, v in zip(at, values)}
    part = {int(i) + 9: v for at, values in R.on_grid(q.slice(9), y.slice(9), grid, block=3) for i, v in zip(at, values)}
    assert part.keys() == {i for i in whole if i >= 9} and all(np.array_equal(part[i], whole[i]) for i in part)


def calibrants(spark):
    rng = np.random.default_rng(1)
    grid = np.linspace(2.0, 23.0, 300)
    rows = [(k, f"s{k}", "7", f"{k}.h5", [float(v) for v in grid], [float(v) for v in np.sin(grid * (1 + k / 50)) ** 2 + rng.random(300) * 0.05]) for k in range(6)]
    rows += [(6, "s6", None, "6", None, None), (7, "s7", "7", "7", [2.0, 3.0], [math.nan, None]), (8, "s8", "7", "8", [float(v) for v in grid], [1.0] * 300)]
    return spark.createDataFrame(rows, PROFILES).withColumn("started_on", F.lit("2026-01-01").cast("date"))


def test_rows_without_profile_keep_null_results(spark):
    df = calibrants(spark)
    got = {r["vec_id"]: r for r in calibration.left_shoulder_metric(df, df.where("vec_id < 2"), q_min=2.0, q_max=23.0, points=600).collect()}
    assert set(got) == set(range(9))
    for k in (6, 7):
        assert all(got[k][c] is None for c in ("kbeta_left_net_area", "peak_window_details", "n_kbeta_windows", "reference_fit_scale"))
    assert got[8]["kbeta_left_net_area"] == pytest.approx(0.0) and len(got[0]["peak_windows"]) == got[0]["n_kbeta_windows"]


def test_flat_reference_fits_nowhere(spark):
    df = calibrants(spark)
    flat = df.where("vec_id = 8")
    rows = calibration.left_shoulder_metric(df, flat, q_min=2.0, q_max=23.0, points=200).collect()
    assert len(rows) == 9 and all(r["kbeta_left_net_area"] is None and r["reference_fit_scale"] is None for r in rows)
    assert calibration.left_shoulder_metric(df, flat, q_min=2.0, q_max=23.0, points=200, fits_only=True).count() == 0
    assert {r["shoulder_positive_area"] for r in calibration.shoulder_metric(df, flat, q_min=2.0, q_max=23.0, shoulder=(8.0, 9.5)).collect()} == {None}


def test_metrics_need_no_shuffle(spark):
    df = calibrants(spark)
    for out in (calibration.left_shoulder_metric(df, df, q_min=2.0, q_max=23.0, points=200), calibration.shoulder_metric(df, df, q_min=2.0, q_max=23.0, shoulder=(8.0, 9.5))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan
