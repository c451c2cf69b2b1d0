"""Packed bootstrap replicates against the drawn samples written out, with small blocks, ties and a patient of many cases."""

import numpy as np
import pytest

from bilatera.operators import folds, newton
from bilatera.operators import replicates as R


def cases(spark, n=70, ties=True):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        for k in range(60 if i == 0 else 1 + i % 3):  # the first patient holds a third of all cases
            p = float(rng.integers(1, 12)) / 12 if ties and k % 2 else float(rng.random())
            rows.append((f"P{i}::{k}", f"P{i}", int(rng.random() < p), p, 0.4))
    return spark.createDataFrame(rows, "target_case_id string, patientId string, label int, p_cancer double, threshold_target double").repartition(5)


def samples(c, weights, b):
    w = {r["patientId"]: r["w"] for r in weights if r["b"] == b}
    rows = [(x["label"], x["p_cancer"]) for x in c for _ in range(w.get(x["patientId"], 0))]
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return (np.sum(pos[:, None] > neg) + 0.5 * np.sum(pos[:, None] == neg)) / (len(pos) * len(neg)) if len(pos) and len(neg) else None


def precision(y, p):
    out = 0.0
    for t in np.unique(p):
        at = p >= t
        out += y[p == t].sum() * y[at].sum() / at.sum()
    return out / y.sum() if y.sum() else None


@pytest.mark.parametrize("block", [1 << 16, 9, 2])
def test_rank_metrics_of_blocks(spark, block):
    c = cases(spark)
    local, weights = c.collect(), folds.bootstrap_weights(c, replicates=12, seed=3).collect()
    got = {r["b"]: r for r in folds.bootstrap_metrics(c, replicates=12, seed=3, block=block).collect()}
    for b in range(12):
        y, p = samples(local, weights, b)
        assert got[b]["roc_auc"] == pytest.approx(auc(y, p), abs=1e-12) and got[b]["pr_auc"] == pytest.approx(precision(y, p), abs=1e-12)
        assert got[b]["brier_score"] == pytest.approx(np.mean((p - y) ** 2)) and got[b]["sensitivity"] == pytest.approx(np.mean(p[y == 1] >= 0.4))


def test_one_score_for_all(spark):
    c = cases(spark).selectExpr("target_case_id", "patientId", "label", "0.5D p_cancer", "threshold_target")
    got = folds.bootstrap_metrics(c, replicates=6, seed=1, block=3).collect()
    assert got and all(r["roc_auc"] == pytest.approx(0.5) for r in got)


def test_counts_keep_their_width(spark):
    rows = np.array([[0, 3, 255], [1, 256, 2], [70000, 0, 1], [5_000_000_000, 1, 1]])
    import pyarrow as pa

    assert np.array_equal(R.decode(pa.array(R.encode(rows), pa.binary()), 3), rows)


def test_calibration_of_replicates(spark):
    c = cases(spark, ties=False)
    local, weights = c.collect(), folds.bootstrap_weights(c, replicates=8, seed=5).collect()
    fitted = {r["b"]: r for r in R.calibration(folds.packed_cases(c, replicates=8, seed=5), 8).collect()}
    for b in range(8):
        y, p = samples(local, weights, b)
        x, a, s = np.log(p / (1 - p)), fitted[b]["calibration_intercept"], fitted[b]["calibration_slope"]
        r = 1 / (1 + np.exp(-(a + s * x))) - y
        assert abs(r.sum()) < 1e-6 and abs((r * x).sum() + s / 1e6) < 1e-6


def test_newton_state_halves_a_bad_step():
    """A step that raised the loss is halved, a key without curvature is flat, others go on."""
    s = newton.State(3)
    good = np.array([[1.0, 0.5, 0.2, 1.0, 0.0, 1.0]] * 3)
    good[2, 3:] = 0.0
    s.advance(good, 1e6)
    assert s.status.tolist() == [newton.MOVES, newton.MOVES, newton.FLAT]
    a = s.a.copy()
    worse = good.copy()
    worse[1, 0] = 9.0
    s.advance(worse, 1e6)
    assert s.a[1] == pytest.approx(a[1] / 2) and s.a[0] != pytest.approx(a[0] / 2)


def test_positions_with_equal_and_hot_keys(spark):
    """Positions are complete within every key, one key holds most rows, and equal rows share a stretch."""
    from bilatera.operators import ordered

    rows = [("hot", i % 50) for i in range(2000)] + [("b", 3), ("c", 1), ("c", 0)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = ordered.dense_index(df, ["v"], ["k"]).collect()
    for k in ("hot", "b", "c"):
        mine = sorted((r["ix"], r["v"]) for r in got if r["k"] == k)
        assert [i for i, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for x, v in rows if x == k)
    assert ordered.dense_index(df.limit(0), ["v"], ["k"]).count() == 0


@pytest.mark.parametrize("role", ["test", "train"])
def test_split_sums_equal_copied_rows(spark, role):
    from pyspark.sql import functions as F

    c = cases(spark)
    assigned = folds.assign_folds(c, folds=4, repeats=3, seed=2)
    got = {r["split_id"]: r for r in folds.split_sums(c, assigned, {"n": F.lit(1), "s": F.col("p_cancer")}, folds=4, role=role).collect()}
    rows = folds.split_rows(c, folds.split_members(assigned, folds=4), role)
    want = {r["split_id"]: r for r in rows.groupBy("split_id").agg(F.count("*").alias("n"), F.sum("p_cancer").alias("s")).collect()}
    assert got.keys() == want.keys() == set(range(12))
    assert all(got[k]["n"] == want[k]["n"] and got[k]["s"] == pytest.approx(want[k]["s"]) for k in got)
