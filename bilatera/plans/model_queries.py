"""Registered queries that fit or apply the two-stage model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import profiles as P
from .. import schemas as S
from ..operators import cases, filters, folds, metrics, model, scoring
from ..sources import storage
from . import frozen, routes
from . import views as V
from .queries import PONI, query, r6

def prediction_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Technical quality control only, all rows of the asked patients."""
    policy = routes.prediction_policy(
        band=V.VIEW_BAND, gate=V.VIEW_GATE, columns=("measurement_id", *S.PREDICTION_COLUMNS),
    )
    rows = V.measurements(spark, sf).withColumns(
        {
            "operator_id": F.when(F.col("measurement_id") % 4 != 3, F.concat(F.lit("op"), F.substring("patientId", 5, 1))),
            "session_uid": F.concat(F.lit("s"), "patientId"),
            "started_at": F.col("started_on").cast("string"),
        }
    )
    return routes.run_steps(rows, routes.build_steps(policy))


def flat(df: DataFrame) -> DataFrame:
    """Nested fields as columns of their own, joined by two underscores; lists as text."""
    out = []

    def walk(kind, column, name):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, column[f.name], f"{name}__{f.name}" if name else f.name)
        else:
            out.append((F.concat_ws(",", column) if isinstance(kind, T.ArrayType) else column).alias(name))

    for f in df.schema.fields:
        walk(f.dataType, F.col(f.name), f.name)
    return df.select(*out)


def scored_sides(spark: SparkSession, sf: str):
    """The saved model and everything a report of the view's requests needs."""
    a = frozen.saved_model(spark, sf)
    rows = storage.cut_lineage(prediction_rows(spark, sf))
    asked = scoring.request_sides(V.requests(spark, sf), rows)
    sides = storage.cut_lineage(scoring.both_sides(asked))
    features = scoring.feature_rows(rows, sides, a.profile, shared_axis=True)
    return a, rows, asked, sides, scoring.score_sides(features, a.final, policy=a.policy, reference=a.reference)


def training_features(spark: SparkSession, sf: str, first: model.ProfileModel) -> DataFrame:
    """Case table of the view cohort with the evidence of a first stage."""
    rows = storage.cut_lineage(V.gated(spark, sf))
    base = model.case_features(rows, shared_axis=True, ambiguous=V.AMBIGUOUS)
    scores = cases.case_scores(base, first.score(filters.stage1_rows(rows)))
    return storage.cut_lineage(cases.reliability(base.join(scores, "target_case_id")))


@query("m1_profile_fit")
def _(spark, sf):
    fit = model.fit_profile_model(filters.stage1_rows(V.gated(spark, sf)))
    return model.parameter_table(spark, fit).select("param", "ix", r6("value", digits=4))


@query("m2_profile_scores")
def _(spark, sf):
    return frozen.saved_model(spark, sf).profile.score(V.gated(spark, sf)).select("measurement_id", r6("p"))


@query("m3_gated_fit")
def _(spark, sf):
    features = training_features(spark, sf, frozen.profile_model())
    return model.parameter_table(spark, model.GatedLogistic(c=model.FINAL_C).fit(features)).select("param", "ix", r6("value", digits=4))


@query("m10_fit_record")
def _(spark, sf):
    a = frozen.saved_model(spark, sf)
    scored = a.final.transform(training_features(spark, sf, a.profile))
    out = metrics.fit_record(scored, a.policy.threshold)
    return out.select(*[r6(f.name) if f.dataType.simpleString() == "double" else f.name for f in out.schema.fields])


def _evaluation(spark, sf):
    g = storage.cut_lineage(V.gated(spark, sf))
    base = storage.cut_lineage(model.case_features(g, shared_axis=True, ambiguous=V.AMBIGUOUS))
    assigned = folds.assign_folds(base, folds=5, repeats=20, seed=42)
    return model.cross_validate(filters.stage1_rows(g), base, assigned, grid_points=V.VIEW_GRID)


@query("m12_cross_validation")
def _(spark, sf):
    rows, _ = _evaluation(spark, sf)
    return rows


@query("m12_held_out_predictions")
def _(spark, sf):
    _, predictions = _evaluation(spark, sf)
    return predictions


@query("m18_request_features")
def _(spark, sf):
    rows = storage.cut_lineage(prediction_rows(spark, sf))
    sides = scoring.both_sides(scoring.request_sides(V.requests(spark, sf), rows)).where("role = 'target'")
    out = scoring.feature_rows(rows, sides, frozen.profile_model(), shared_axis=True)
    return out.select(
        "patientId", "target_case_id", "target_side", "contralateral_side", r6("profile_p_cancer_logit_average"), r6("profile_p_cancer_probability_mean"),
        "profile_p_cancer_n_measurements", r6("age"), "age_available", "specimens", "measurements", "symmetry_available", "symmetry_reason",
        "target_measurements", "contralateral_measurements", *[r6(c) for c in S.CORE4], "result_reliability", "result_reliability_reason",
        "operator_id", "session_uid", "started_at",
    )


@query("m19_two_sided_scores")
def _(spark, sf):
    *_, out = scored_sides(spark, sf)
    return out.select(
        "patientId", "role", "target_side", "symmetry_available", r6("p_cancer"), "target_class_risk_level", "biopsy_required", "tier",
        "result_reliability", r6("percentile_all"), r6("percentile_reference_class"), r6("percentile_target_class"),
    )


@query("m20_profile_evidence")
def _(spark, sf):
    a, rows, _, sides, _ = scored_sides(spark, sf)
    return scoring.report_evidence(scoring.side_evidence(rows, sides, a.profile), a.report_identity())


CREATED = "2026-01-01T00:00:00+01:00"


@query("m21_external_report")
def _(spark, sf):
    a, _, asked, _, out = scored_sides(spark, sf)
    return flat(scoring.external_report(out, asked, record=a.record, identity=a.report_identity(), created_at=F.lit(CREATED)))


def _internal(spark, sf):
    a, _, asked, _, out = scored_sides(spark, sf)
    return scoring.internal_report(out, asked, record=a.record, identity=a.report_identity(), created_at=F.lit(CREATED))


@query("m22_internal_report")
def _(spark, sf):
    return flat(_internal(spark, sf)).drop("model__artifact_sha256")


@query("a8_report_sink")
def _(spark, sf):
    df = _internal(spark, sf)
    path = storage.write_json(df, storage.new_path(spark, "reports"))
    return flat(spark.read.schema(df.schema).json(path)).drop("model__artifact_sha256")


@query("m23_routed_scores")
def _(spark, sf):
    a = frozen.saved_model(spark, sf)
    plain = frozen.final_model(frozen.PLAIN_COEF, frozen.PLAIN_INTERCEPT)
    out = scoring.routed_score(training_features(spark, sf, a.profile), a.final, plain, {"paired": a.policy.threshold, "fallback_no_symmetry": 0.5})
    return out.select("target_case_id", "model_route", r6("p_cancer"), r6("threshold"))


@query("m26_train_all")
def _(spark, sf):
    fit = model.train(V.gated(spark, sf), evaluate=True, grid_points=V.VIEW_GRID, shared_axis=True, ambiguous=V.AMBIGUOUS)
    summary = metrics.summarise_splits(fit.split_metrics)
    held = metrics.held_out_extract(summary)
    p = fit.policy
    return held.select(
        "held_out_metrics.*", F.lit(p.threshold).alias("decision_threshold"), F.lit(p.borderline).alias("borderline_margin"),
        F.lit(p.outer).alias("outer_margin"),
    )


@query("m26_pooled_summary")
def _(spark, sf):
    out = folds.pooled_summary(V.oof(spark, sf), replicates=200, seed=42, with_calibration=False)
    return out.select("metric", *[r6(c) for c in ("pooled", "ci_low", "ci_high")], "replicates", "patients", "cases")


@query("u1_step_chain")
def _(spark, sf):
    policy = routes.training_policy(
        excluded_ids=V.EXCLUDED_IDS, excluded_dates=V.EXCLUDED_DAYS, band=V.VIEW_BAND, gate=V.VIEW_GATE,
        columns=("measurement_id", *S.TRAINING_COLUMNS), column_errors="ignore",
    )
    out = routes.run_steps(V.measurements(spark, sf), routes.build_steps(policy))
    return out.select(
        "measurement_id", "patientId", "product_status_group", "patient_product_diagnosis", "specimen_measurement_count",
        r6("radial_profile_value_at_q"), r6(P.total(F.col("radial_profile_data")), "profile_sum"),
    )


@query("u1_pixel_route")
def _(spark, sf):
    """From geometry text and pixels to gated profiles, all steps of the prediction route with their inputs."""
    rows = V.measurements(spark, sf).withColumn("ponifile", F.expr(PONI.replace("15+measurement_id%10", "10+measurement_id%10"))).drop("poni_q_max_nm_inv", "q_range", "radial_profile_data")
    pixels = V.pixels(spark, sf).select("measurement_id", "q", F.col("bright").alias("counts"), "radius")
    policy = routes.prediction_policy(
        has_geometry=True, has_pixels=True, band=(2.0, 23.0), gate=0.5, min_snr_db=20.0,
        columns=("measurement_id", "patientId", "poni_q_max_nm_inv", "thickness_factor", "snr_db", "radial_profile_value_at_q", "q_range", "radial_profile_data"),
    )
    out = routes.run_steps(rows, routes.build_steps(policy, pixels=pixels))
    return out.select(
        "measurement_id", "patientId", r6("poni_q_max_nm_inv"), r6("thickness_factor"), r6("snr_db"), r6("radial_profile_value_at_q"),
        F.size("q_range").alias("points"), r6(P.total(F.col("radial_profile_data")), "profile_sum"),
    )


@query("u2_prediction_route")
def _(spark, sf):
    return prediction_rows(spark, sf).select(
        "measurement_id", "patientId", "product_status_group", "specimen_measurement_count", r6("radial_profile_value_at_q")
    )


def _spread(q: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([float(np.max(v) - np.min(v)) for v in y])


@query("u3_profile_hook")
def _(spark, sf):
    return routes.per_profile(V.measurements(spark, sf), _spread, "spread").select("measurement_id", r6("spread"))


def _side_range(pdf: pd.DataFrame) -> pd.DataFrame:
    y = np.stack(pdf["radial_profile_data"].to_numpy())
    return pd.DataFrame({"patientId": pdf["patientId"].iloc[:1], "side": pdf["side"].iloc[:1], "lo": [float(y.min())], "hi": [float(y.max())]})


def _side_spread(states: pd.DataFrame) -> pd.DataFrame:
    return states.iloc[:1][["patientId", "side"]].assign(spread=states["hi"].max() - states["lo"].min())


@query("u3_case_hook")
def _(spark, sf):
    df = V.measurements(spark, sf).select("patientId", "side", "radial_profile_data")
    out = routes.per_case(
        df, _side_range, _side_spread, "patientId string, side string, lo double, hi double", "patientId string, side string, spread double")
    return out.select("patientId", "side", r6("spread"))
