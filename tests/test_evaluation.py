"""Thresholds, metrics, folds, bootstrap and tiers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bilatera.operators import folds, metrics, ordered, tiers


def roc(y, s):
    """Corner points by the public definition, with the (inf, 0, 0) start."""
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    at = np.r_[np.flatnonzero(np.diff(s)), len(s) - 1]
    tp = np.cumsum(y)[at]
    fp = 1 + at - tp
    if len(fp) > 2:
        keep = np.r_[True, np.logical_or(np.diff(fp, 2), np.diff(tp, 2)), True]
        tp, fp, at = tp[keep], fp[keep], at[keep]
    return np.r_[0, fp] / fp[-1], np.r_[0, tp] / tp[-1], np.r_[np.inf, s[at]]


def expected_thresholds(y, s, target):
    f, t, c = roc(y, s)
    j = int(np.argmax(t - f))
    ok = np.flatnonzero(t >= target)
    return c[j], (c[ok[np.argmin(f[ok])]] if len(ok) else c[j]), bool(len(ok))


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_thresholds_and_auc_over_random_sets(spark, partitions):
    rng = np.random.default_rng(7)
    sets = {}
    for k in range(30):
        n = int(rng.integers(4, 60))
        s = rng.random(n) if k % 2 else rng.integers(0, 6, n) / 7.0
        y = np.r_[0, 1, rng.integers(0, 2, n - 2)]
        sets[k] = (y, s)
    rows = [(k, int(a), float(b)) for k, (y, s) in sets.items() for a, b in zip(y, s)]
    df = spark.createDataFrame(rows, "k int, y int, p double")
    curve = metrics.score_curve(df, ["k"], partitions=partitions)
    got = {r["k"]: r for r in metrics.thresholds(metrics.roc_points(curve, ["k"]), ["k"]).collect()}
    auc = {r["k"]: r for r in metrics.rank_metrics(curve, ["k"]).collect()}
    for k, (y, s) in sets.items():
        youden, target, reached = expected_thresholds(y, s, 0.95)
        assert (got[k]["threshold_youden"], got[k]["threshold_target"], got[k]["target_reached"]) == (youden, target, reached), k
        pos, neg = s[y == 1], s[y == 0]
        want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
        assert auc[k]["roc_auc"] == pytest.approx(want)


def test_unreachable_target_falls_back(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.1)], "y int, p double")
    r = metrics.thresholds(metrics.roc_points(metrics.score_curve(df)), target=1.1).first()
    assert not r["target_reached"] and r["threshold_target"] == r["threshold_youden"]


def test_running_totals_across_partitions(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 500, 3000)
    df = spark.createDataFrame([(int(x),) for x in v], "v int")
    got = {r["v"]: r for r in ordered.running_totals(df, "v", {"n": F.lit(1)}, partitions=16).collect()}
    values = sorted(set(v.tolist()))
    for i, x in enumerate(values):
        assert got[x]["n_cum"] == int((v <= x).sum()) and got[x]["n_all"] == len(v)
        nxt = int((v == values[i + 1]).sum()) if i + 1 < len(values) else None
        assert got[x]["n_next"] == nxt


def test_exact_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.normal(size=2000), "a": rng.normal(size=7), "b": rng.normal(size=1)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k string, v double")
    got = {r["k"]: r for r in ordered.quantiles(df, "v", {"m": 0.5, "lo": 0.025}, ["k"]).collect()}
    for k, v in groups.items():
        assert got[k]["m"] == pytest.approx(np.median(v)) and got[k]["lo"] == pytest.approx(np.quantile(v, 0.025))


def test_confusion_zero_denominator(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")
    r = metrics.confusion_metrics(df, threshold=F.lit(0.5)).first()
    assert r["sensitivity"] is None and r["ppv"] is None and r["specificity"] == 1.0 and r["balanced_accuracy"] == 1.0


def test_calibration_small_and_distributed_agree(spark):
    rng = np.random.default_rng(3)
    p = rng.random(400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + 0.6 * np.log(p / (1 - p)))))).astype(int)
    df = spark.createDataFrame([(int(i % 2), int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "k int, y int, p double")
    one = {r["k"]: r for r in metrics.calibration(df, ["k"]).collect()}
    with pytest.raises(ValueError, match="settle"):
        metrics.calibration(df, ["k"], iterations=1)
    # Gradient of the penalised loss vanishes.
    x, yy = np.log(p[::2] / (1 - p[::2])), y[::2]
    a, b = one[0]["calibration_intercept"], one[0]["calibration_slope"]
    r = 1 / (1 + np.exp(-(a + b * x))) - yy
    assert abs(r.sum()) < 1e-6 and abs((r * x).sum() + b / 1e6) < 1e-6


def test_one_class_calibration_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "y int, p double")
    assert metrics.calibration(df).first()["calibration_slope"] is None


def cases(spark, n=53):
    rng = np.random.default_rng(4)
    rows = [(f"P{i}::{s}", f"P{i}", int(i % 3 == 0 and s == "LEFT"), float(rng.random()), 0.4)
            for i in range(n) for s in (("LEFT", "RIGHT") if i % 4 == 0 else ("LEFT",))]
    return spark.createDataFrame(rows, "target_case_id string, patientId string, label int, p_cancer double, threshold_target double")


def test_folds_are_patient_safe_and_balanced(spark):
    assigned = folds.assign_folds(cases(spark), folds=5, repeats=20, seed=42)
    rows = assigned.collect()
    assert len(rows) == 53 * 20 and len({(r["repeat"], r["patientId"]) for r in rows}) == 53 * 20
    for rep in range(20):
        for label in (0, 1):
            n = np.bincount([r["fold"] for r in rows if r["repeat"] == rep and r["label"] == label], minlength=5)
            assert n.max() - n.min() <= 1
    members = folds.split_members(assigned, folds=5)
    assert folds.leakage(members).count() == 0
    assert members.where("role='test'").count() == 53 * 20 and members.select("split_id").distinct().count() == 100


def test_bootstrap_draws_and_metrics(spark):
    c = cases(spark)
    w = folds.bootstrap_weights(c, replicates=5, seed=1).collect()
    for b in range(5):
        assert sum(r["w"] for r in w if r["b"] == b) == 53
    local = [r.asDict() for r in c.collect()]
    got = {r["b"]: r for r in folds.bootstrap_metrics(c, replicates=5, seed=1).collect()}
    for b in range(5):
        sample = [x for r in w if r["b"] == b for x in local if x["patientId"] == r["patientId"] for _ in range(r["w"])]
        y, p = np.array([x["label"] for x in sample]), np.array([x["p_cancer"] for x in sample])
        pos, neg = p[y == 1], p[y == 0]
        assert got[b]["roc_auc"] == pytest.approx(np.mean([(i > j) + 0.5 * (i == j) for i in pos for j in neg]))
        assert got[b]["brier_score"] == pytest.approx(np.mean((p - y) ** 2))
        assert got[b]["sensitivity"] == pytest.approx(np.mean(pos >= 0.4))


@pytest.mark.parametrize("p,want", [(0.10, 1), (0.20, 2), (0.25, 3), (0.40, 4), (0.70, 5)])
def test_tiers(spark, p, want):
    t = tiers.tier(F.lit(p), F.lit(0.25), F.lit(0.5), F.lit(1.5))
    assert spark.range(1).select(t.alias("t")).first()["t"] == want


def test_tier_policy_from_unstable_cases(spark):
    rows = [(f"C{c}", 0.25, s % 2) for c in range(5) for s in range(4)]
    p = tiers.fit_policy(spark.createDataFrame(rows, "target_case_id string, p_cancer double, y_pred_target int"), 0.25)
    assert (p.borderline, p.outer) == (0.1, 0.3)
    assert tiers.fit_policy(None, 0.25) == tiers.TierPolicy(0.25, 0.5, 1.5)
    with pytest.raises(ValueError):
        tiers.TierPolicy(0.25, 2.0, 2.0).check()


def test_parameter_diff(spark):
    a = spark.createDataFrame([("x", 0, 1.0), ("x", 1, float("nan")), ("y", 0, 2.0)], "param string, ix int, value double")
    b = spark.createDataFrame([("x", 0, 1.0 + 1e-13), ("x", 1, float("nan")), ("z", 0, 2.0)], "param string, ix int, value double")
    assert sorted((r["param"], r["status"]) for r in metrics.parameter_diff(a, b).collect()) == [("y", "left_only"), ("z", "right_only")]


def test_only_finite_values_are_statistics(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", nan), ("a", 40.0), ("a", 50.0), ("b", nan)], "k string, v double")
    assert {r["k"]: r["m"] for r in ordered.quantiles(df, "v", {"m": 0.5}, ["k"]).collect()} == {"a": 45.0}
    assert ordered.quantiles(df, "v", {"m": 0.5}).first()["m"] == 45.0
    ref = spark.createDataFrame([(0, 0.5), (0, nan), (1, 0.4)], "y int, p double")
    got = metrics.score_percentiles(spark.createDataFrame([(0.6,), (nan,), (None,)], "p double"), ref).collect()
    assert sorted(r["percentile_all"] is None for r in got) == [False, True, True]
    assert [r["percentile_reference_class"] for r in got if r["percentile_all"] is not None] == [1.0]
    with pytest.raises(Exception, match="both classes"):
        metrics.score_percentiles(spark.createDataFrame([(0.6,)], "p double"), ref.where("y = 0")).collect()


def test_score_percentiles_count_ties(spark):
    ref = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.2), (1, 0.9)], "y int, p double")
    got = {r["p"]: r for r in metrics.score_percentiles(spark.createDataFrame([(0.2,), (0.05,), (1.0,)], "p double"), ref).collect()}
    assert (got[0.2]["percentile_all"], got[0.2]["percentile_reference_class"], got[0.2]["percentile_target_class"]) == (0.75, 1.0, 0.5)
    assert got[0.05]["percentile_all"] == 0.0 and got[1.0]["percentile_all"] == 1.0
