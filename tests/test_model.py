"""Fits against numpy Newton solutions, evaluation, scoring and reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bilatera import schemas as S
from bilatera.operators import cases, filters, folds, metrics, model, scoring, tiers
from bilatera.plans import routes
from bilatera.sources import storage

GRID = 60
Q = [float(v) for v in np.linspace(2.0, 23.0, GRID)]


def measurement_rows(patients=30, reps=2, seed=5):
    rng = np.random.default_rng(seed)
    rows, m = [], 0
    for p in range(patients):
        for side in ("Left", "Right") if p % 7 != 5 else ("Left",):
            label = "CANCER" if p % 3 == 0 and side == "Left" else "BENIGN"
            shift = 0.3 if label == "CANCER" else 0.0
            for r in range(reps):
                y = 2 + shift + np.sin(np.array(Q) / 3) * 0.5 + 0.01 * r + 0.3 * rng.normal(size=GRID)
                rows.append((m, f"P{p:02d}", f"P{p:02d}_{side}", side, label, side == "Left", float(40 + p), Q, [float(v) for v in y]))
                m += 1
    return rows


SCHEMA = ("measurement_id long, patientId string, specimenId string, side string, product_status_group string, biopsy boolean, "
          "age double, q_range array<double>, radial_profile_data array<double>")


@pytest.fixture(scope="module")
def rows(spark):
    return storage.cut_lineage(spark.createDataFrame(measurement_rows(), SCHEMA))


def newton(x, y, c):
    n, k = len(y), int(y.sum())
    w = np.where(y == 1, n / (2 * k), n / (2 * (n - k)))
    z = np.hstack([np.ones((n, 1)), x])
    ridge = np.eye(z.shape[1]) / c
    ridge[0, 0] = 0
    b = np.zeros(z.shape[1])
    for _ in range(100):
        mu = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * mu * (1 - mu))[:, None]).T @ z + ridge, z.T @ (w * (mu - y)) + ridge @ b)
    return b


def test_profile_fit_matches_newton(spark, rows):
    admitted = filters.stage1_rows(rows)
    fit = model.fit_profile_model(admitted)
    local = admitted.collect()
    x = np.array([r["radial_profile_data"] for r in local])
    y = np.array([int(r["product_status_group"] == "CANCER") for r in local])
    b = newton((x - x.mean(0)) / x.std(0), y, 0.1)
    assert np.allclose(fit.coef, b[1:], atol=1e-5) and fit.intercept == pytest.approx(b[0], abs=1e-5)
    p = {r["measurement_id"]: r["p"] for r in fit.score(admitted).collect()}
    want = 1 / (1 + np.exp(-(((x - x.mean(0)) / x.std(0)) @ b[1:] + b[0])))
    assert np.allclose([p[r["measurement_id"]] for r in local], want, atol=1e-5)


def local_features(feats):
    pdf = feats.toPandas().sort_values("target_case_id").reset_index(drop=True)
    return pdf


def design(train, pdf, evidence_train, evidence):
    base_t = np.column_stack([evidence_train, train["age"], train["age_available"]]).astype(float)
    base = np.column_stack([evidence, pdf["age"], pdf["age_available"]]).astype(float)
    sd = base_t.std(0)
    sd[sd < 1e-12] = 1
    gate_t, gate = train["symmetry_available"].to_numpy() == 1, pdf["symmetry_available"].to_numpy() == 1
    core_t, core = train[list(S.CORE4)].to_numpy(float), pdf[list(S.CORE4)].to_numpy(float)
    z = (core - core_t[gate_t].mean(0)) / core_t[gate_t].std(0)
    z[~gate] = 0
    return np.hstack([(base - base_t.mean(0)) / sd, z])


def test_cross_validation_matches_direct_refits(spark, rows):
    base = storage.cut_lineage(model.case_features(rows))
    assigned = folds.assign_folds(base, folds=3, repeats=2, seed=9)
    m, predictions = model.cross_validate(filters.stage1_rows(rows), base, assigned, grid_points=GRID, fold_count=3, repeats=2)
    got = {(r["split_id"], r["target_case_id"]): r for r in predictions.collect()}
    fold = {(r["repeat"], r["patientId"]): r["fold"] for r in assigned.collect()}
    pdf, local = local_features(base), filters.stage1_rows(rows).toPandas()
    x = np.stack(local["radial_profile_data"].to_numpy())
    y = (local["product_status_group"] == "CANCER").to_numpy(int)
    for split in range(6):
        rep, k = divmod(split, 3)
        tr = np.array([fold[(rep, p)] != k for p in local["patientId"]])
        mean, sd = x[tr].mean(0), x[tr].std(0)
        b = newton((x[tr] - mean) / sd, y[tr], 0.1)
        local["logit"] = np.clip((x - mean) / sd @ b[1:] + b[0], -13.815509557963773, 13.815509557963773)
        ev = 1 / (1 + np.exp(-local.groupby("patientId")["logit"].mean()))
        e = pdf["patientId"].map(ev).to_numpy()
        in_train = np.array([fold[(rep, p)] != k for p in pdf["patientId"]])
        train = pdf[in_train]
        b2 = newton(design(train, train, e[in_train], e[in_train]), train["label"].to_numpy(int), 0.1)
        p = 1 / (1 + np.exp(-(design(train, pdf, e[in_train], e) @ b2[1:] + b2[0])))
        test = [i for i in range(len(pdf)) if not in_train[i]]
        assert {pdf["target_case_id"][i] for i in test} == {c for s, c in got if s == split}
        for i in test:
            assert got[(split, pdf["target_case_id"][i])]["p_cancer"] == pytest.approx(p[i], abs=1e-6)
    record = m.collect()
    assert len(record) == 6 and all(r["train_patients"] + r["test_patients"] == 30 for r in record)
    assert all(r["tp_target"] + r["fn_target"] + r["tn_target"] + r["fp_target"] == r["test_target_cases"] for r in record)


@pytest.fixture(scope="module")
def fit(rows):
    return model.train(rows, grid_points=GRID)


def test_train_all_and_parameter_round_trip(spark, fit):
    assert fit.features.count() == 30 and fit.scored.where("label = 1").count() == 10
    table = model.parameter_table(spark, fit.profile, fit.final)
    first, final = model.load_models(table)
    assert first == fit.profile
    again = model.parameter_table(spark, first, final)
    assert metrics.parameter_diff(table, again).count() == 0
    rec = metrics.fit_record(fit.scored, fit.thresholds["threshold_target"]).first()
    assert rec["evaluation_status"] == "in_sample_not_independent" and rec["sensitivity"] >= 0.95


def test_gate_is_not_a_predictor(spark, fit):
    """Closing the gate only removes the paired terms."""
    off = fit.final.transform(fit.features.withColumn("symmetry_available", F.lit(0)))
    zeroed = model.GatedLogisticModel(fit.final.stats, (*fit.final.coef[:3], 0.0, 0.0, 0.0, 0.0), fit.final.intercept)
    a = {r["target_case_id"]: r["p_cancer"] for r in off.collect()}
    b = {r["target_case_id"]: r["p_cancer"] for r in zeroed.transform(fit.features).collect()}
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_requests_reports_and_json(spark, rows, fit):
    mixed = rows.where("not (patientId = 'P02' and side = 'Right')").withColumns(
        {"operator_id": F.lit(" op "), "session_uid": F.concat(F.lit("s"), "measurement_id")}
    )
    asked = scoring.request_sides(
        spark.createDataFrame(
            [("P00", "left", "A", ""), ("P01", "Right", "A", "c"), ("P02", "LEFT", "A", ""), ("P02x", "left", "A", ""),
             ("P03", "up", "A", "")],
            "patientId string, target_side string, analysis_author string, prediction_comment string"), mixed)
    status = {r["patientId"]: r["status"] for r in asked.collect()}
    assert status == {"P00": "ok", "P01": "ok", "P02": "ok", "P02x": "patient_not_found", "P03": "invalid_target_side"}
    sides = scoring.both_sides(asked)
    feats = scoring.feature_rows(mixed, sides, fit.profile)
    out = scoring.score_sides(feats, fit.final, policy=fit.policy, reference=fit.scored.select("label", "p_cancer"))
    by = {(r["patientId"], r["role"]): r for r in out.collect()}
    assert len(by) == 5
    assert by[("P00", "contralateral")]["symmetry_available"] == 0
    assert by[("P00", "contralateral")]["result_reliability"] == "low"
    assert by[("P00", "target")]["operator_id"] == "op" and by[("P00", "target")]["session_uid"] is None
    train = {r["target_case_id"]: r["p_cancer"] for r in fit.scored.collect()}
    assert by[("P00", "target")]["p_cancer"] == pytest.approx(train["P00::LEFT"], abs=1e-9)
    ident = {"id": "m", "name": "n", "version": "1", "sha256": "x", "external_version": "0.6", "internal_version": "0.9"}
    rec = {"sensitivity": 0.960531, "specificity": None}
    ext = {r["patient_id"]: r for r in scoring.external_report(out, asked, record=rec, identity=ident, created_at=F.lit("t")).collect()}
    assert ext["P01"]["target_side"] == "right" and ext["P01"]["prediction_comment"] == "c"
    assert ext["P00"]["model_metrics"]["sensitivity"] == "0.96053" and ext["P00"]["model_metrics"]["specificity"] == "unknown"
    inner = scoring.internal_report(out, asked, record=rec, identity=ident, created_at=F.lit("t"))
    docs = {d["scan_metadata"]["patient_id"]: d for d in (json.loads(r["j"]) for r in inner.select(F.to_json(F.struct("*")).alias("j")).collect())}
    assert len(docs) == 3
    assert docs["P02"]["breast_predictions"]["contralateral"]["available"] is False
    assert docs["P02"]["breast_predictions"]["contralateral"]["final_prediction"]["p_cancer"] == "unknown"
    assert docs["P00"]["breast_predictions"]["contralateral"]["side"] == "right"
    # Every report's rows are found by its id and side, as many as it says.
    rows_of = {(r["report_id"], r["side"]): r["n"] for r in scoring.report_evidence(
        scoring.side_evidence(mixed, sides, fit.profile), ident).groupBy("report_id", "side").agg(F.count("p").alias("n")).collect()}
    for d in docs.values():
        for side in d["breast_predictions"].values():
            e = side["azimuthal_integration_profile"]["measurement_evidence"]
            assert e["rows"] == rows_of.get((d["report_id"], e["side"]), 0)
            assert e["rows"] == 0 or e["report_id"] == d["report_id"]


def test_large_side_keeps_all_its_rows(spark, rows, fit):
    many = rows.where("patientId = 'P00'").withColumn("measurement_id", F.explode(F.sequence(F.lit(0), F.lit(5999))))
    asked = scoring.request_sides(spark.createDataFrame([("P00", "left")], "patientId string, target_side string"), many)
    sides = scoring.both_sides(asked).where("role = 'target'")
    got = scoring.report_evidence(scoring.side_evidence(many, sides, fit.profile), {"id": "m"})
    assert got.count() == many.where("upper(side) = 'LEFT'").count() > 10_000


def test_report_time_has_the_offset(spark):
    times = spark.sql("select * from values timestamp_ntz'2026-01-15 12:00:00', timestamp_ntz'2026-07-15 12:00:00' t(t)")
    got = [r[0] for r in times.select(scoring.report_time(F.col("t"))).collect()]
    assert got == ["2026-01-15T13:00:00+01:00", "2026-07-15T14:00:00+02:00"]
    assert spark.range(1).select(scoring.report_time()).first()[0][-6] == "+"


def test_steps_skip_disabled_and_refuse_duplicates(spark, rows):
    add = lambda df, v: df.withColumn("x", F.lit(v))
    out = routes.run_steps(rows, [routes.Step("a", add, {"v": 1}), routes.Step("b", add, {"v": 2}, False)])
    assert out.select("x").distinct().collect()[0]["x"] == 1
    with pytest.raises(ValueError):
        routes.run_steps(rows, [routes.Step("a", add, {"v": 1}), routes.Step("a", add, {"v": 2})])


def test_step_counts_of_both_routes():
    train = routes.build_steps(routes.training_policy())
    assert len(train) == 21 and [s.name for s in train][:3] == ["poni_geometry", "select_h5_sessions", "h5_to_df"]
    off = {s.name for s in routes.build_steps(routes.prediction_policy()) if not s.enabled}
    assert {"biopsy_filter", "patient_biopsy_filter", "specimen_status_filter", "product_status_filter", "paired_patient_filter"} <= off


def test_case_hook_merges_states(spark, rows):
    keys = ["patientId", "side"]
    partial = lambda pdf: pdf[keys].head(1).assign(n=len(pdf))
    finish = lambda pdf: pdf[keys].head(1).assign(n=pdf["n"].sum())
    kind = "patientId string, side string, n long"
    got = routes.per_case(rows.select(*keys, "measurement_id").repartition(7), partial, finish, kind, kind)
    want = rows.groupBy(*keys).count()
    assert got.count() == 56 and got.exceptAll(want).count() == 0


def test_case_scores_missing_side_fails(spark, rows):
    c = cases.target_cases(rows)
    with pytest.raises(Exception, match="no scores"):
        cases.case_scores(c, rows.where("patientId <> 'P00'").select("patientId", "side", F.lit(0.5).alias("p"))).collect()


def test_tier_policy_kept_with_model(fit):
    assert isinstance(fit.policy, tiers.TierPolicy) and fit.policy.threshold == fit.thresholds["threshold_target"]
