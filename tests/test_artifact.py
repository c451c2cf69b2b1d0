"""Saved models: round trip, refused schemas and changed content, ML writers, pooled evaluation in training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bilatera.operators import artifact, folds, metrics, model, tiers
from bilatera.plans import frozen

SCORES = "label int, p_cancer double"


def made(spark, **more):
    ref = spark.createDataFrame([(0, 0.2), (1, 0.7), (1, 0.7)], SCORES).repartition(2)
    return artifact.Artifact(
        frozen.profile_model(4), frozen.final_model(), {"threshold_target": 0.4, "target_reached": True}, tiers.TierPolicy(0.4, 0.5, 1.5), ref,
        record={"sensitivity": 0.9}, input_sha256={"rows": "ab"}, name=frozen.NAME, **more)


def features(spark):
    rng = np.random.default_rng(0)
    names = ["target_case_id", "label", "symmetry_available", *[c for c in model.S.BASE3], *model.S.CORE4]
    rows = [(f"c{i}", int(i % 2), int(i % 3 > 0), *[float(v) for v in rng.random(2)], 1, *[float(v) for v in rng.random(4)]) for i in range(40)]
    return spark.createDataFrame(rows, names)


def test_round_trip_scores_alike(spark, tmp_path):
    a = made(spark)
    identity = artifact.save(a, str(tmp_path / "m"))
    b = artifact.load(spark, str(tmp_path / "m"))
    assert b.identity == identity == artifact.digest(a) and b.policy == a.policy and b.thresholds == a.thresholds and b.record == a.record
    assert b.report_identity()["sha256"] == identity and b.profile == a.profile
    f = features(spark)
    assert a.final.transform(f).collect() == b.final.transform(f).collect()
    assert sorted(map(tuple, b.reference.collect())) == [(0, 0.2), (1, 0.7), (1, 0.7)]
    with pytest.raises(Exception, match="(?i)exists"):
        artifact.save(a, str(tmp_path / "m"))


def test_identity_follows_the_content(spark):
    a = made(spark)
    other = artifact.Artifact(**{**a.__dict__, "reference": spark.createDataFrame([(0, 0.2), (1, 0.7)], SCORES)})
    assert artifact.digest(a) != artifact.digest(other)
    assert artifact.digest(a) == artifact.digest(artifact.Artifact(**{**a.__dict__, "reference": a.reference.orderBy(F.desc("p_cancer"))}))
    assert artifact.digest(a) != artifact.digest(artifact.Artifact(**{**a.__dict__, "input_sha256": {"rows": "ac"}}))


def test_other_schema_or_changed_numbers_are_refused(spark, tmp_path):
    a = made(spark)
    path = str(tmp_path / "m")
    artifact.save(a, path)
    parts = spark.read.parquet(f"{path}/parts").collect()
    spark.createDataFrame([("other_v9", *parts[0][1:])], artifact.PARTS).write.mode("overwrite").parquet(f"{path}/parts")
    with pytest.raises(ValueError, match="other_v9"):
        artifact.load(spark, path)
    spark.createDataFrame(parts, artifact.PARTS).write.mode("overwrite").parquet(f"{path}/parts")
    artifact.load(spark, path)
    changed = model.parameter_table(spark, a.profile).collect()
    changed = [(r["param"], r["ix"], r["value"] + (r["ix"] == 1)) for r in changed]
    spark.createDataFrame(changed, "param string, ix int, value double").write.mode("overwrite").parquet(f"{path}/profile")
    with pytest.raises(ValueError, match="identity"):
        artifact.load(spark, path)


def test_estimator_and_model_persist(spark, tmp_path):
    est = model.GatedLogistic(c=0.3, probabilityCol="risk")
    est.write().save(str(tmp_path / "est"))
    again = model.GatedLogistic.load(str(tmp_path / "est"))
    assert again.getOrDefault("c") == 0.3 and again.getOrDefault("probabilityCol") == "risk"
    f = features(spark)
    fitted = est.fit(f)
    fitted.save(str(tmp_path / "model"))
    back = model.GatedLogisticModel.load(str(tmp_path / "model"))
    assert back.uid == fitted.uid and "risk" in back.transform(f).columns
    assert fitted.transform(f).collect() == back.transform(f).collect()
    with pytest.raises(ValueError, match="GatedLogistic"):
        model.GatedLogisticModel.load(str(tmp_path / "est"))


def oof(spark, splits=4, n=60):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        base, y = rng.random(), int(i % 3 == 0)
        for s in range(splits):
            p = float(np.clip(0.25 * y + base * 0.7 + rng.normal() * 0.02, 0.01, 0.99))
            rows.append((f"C{i}", f"P{i // 2}", y, s, p, 0.4 + s / 100))
    return spark.createDataFrame(rows, "target_case_id string, patientId string, label int, split_id int, p_cancer double, threshold_target double")


def test_pooled_summary_equals_its_parts(spark):
    o = oof(spark)
    got = {r["metric"]: r for r in folds.pooled_summary(o, replicates=40, seed=9).collect()}
    pooled = metrics.pool_cases(o)
    whole = metrics.all_metrics(pooled, y="label", p="p_cancer", threshold=F.col("threshold_target")).first()
    parts = {r["metric"]: r for r in folds.bootstrap_intervals(folds.bootstrap_metrics(pooled, replicates=40, seed=9)).collect()}
    for m in folds.BOOT_METRICS:
        assert got[m]["pooled"] == pytest.approx(whole[m]) and got[m]["patients"] == 30 and got[m]["cases"] == 60
        assert (got[m]["ci_low"], got[m]["ci_high"], got[m]["replicates"]) == (pytest.approx(parts[m]["ci_low"]), pytest.approx(parts[m]["ci_high"]), parts[m]["replicates"])
    for m in folds.CALIBRATION:
        assert got[m]["pooled"] == pytest.approx(whole[m]) and got[m]["ci_low"] <= got[m]["ci_high"]
