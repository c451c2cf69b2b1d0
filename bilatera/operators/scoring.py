"""Batch scoring of a request table (patientId, target_side) and the two reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from .. import schemas as S
from ..sources.storage import cut_lineage
from . import asymmetry, cases, filters, metrics, tiers
from .model import GatedLogisticModel, ProfileModel

# Fixed values of the report contract.
NEUTRAL_REASON = "SK symmetry refinement is intentionally unavailable for contralateral scoring"
MISSING_REASON = "contralateral breast is unavailable after preprocessing"


def request_sides(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Requests with normalised sides and a status: ok, invalid_target_side, patient_not_found, target_side_absent."""
    sides = rows.select("patientId", X.side_norm("side").alias("s")).groupBy("patientId").agg(
        F.coalesce(F.max(F.col("s") == "LEFT"), F.lit(False)).alias("_left"),
        F.coalesce(F.max(F.col("s") == "RIGHT"), F.lit(False)).alias("_right"),
    )
    side = X.side_norm("target_side")
    out = requests.withColumn("target_side_norm", side).join(sides, "patientId", "left")
    has = lambda s: F.when(s == "LEFT", F.col("_left")).when(s == "RIGHT", F.col("_right"))
    status = (
        F.when(F.col("target_side_norm").isNull(), "invalid_target_side")
        .when(F.col("_left").isNull(), "patient_not_found")
        .when(~has(F.col("target_side_norm")), "target_side_absent")
        .otherwise("ok")
    )
    other = X.other_side("target_side_norm")
    return out.withColumns(
        {"status": status, "contralateral_side_norm": F.when(has(other), other)}
    ).drop("_left", "_right")


def both_sides(requests: DataFrame) -> DataFrame:
    """Scoring rows: the requested side, and the other side with the gate forced off."""
    ok = requests.where("status = 'ok'")
    target = ok.select(
        "patientId", "target_side_norm", "contralateral_side_norm", F.lit("target").alias("role"),
        F.lit(False).alias("force_gate_off"),
    )
    other = ok.where("contralateral_side_norm is not null").select(
        "patientId", F.col("contralateral_side_norm").alias("target_side_norm"),
        F.col("target_side_norm").alias("contralateral_side_norm"), F.lit("contralateral").alias("role"),
        F.lit(True).alias("force_gate_off"),
    )
    return target.unionByName(other).withColumn(
        "target_case_id", cases.case_id(F.col("patientId"), F.col("target_side_norm"))
    )


def row_scores(rows: DataFrame, first: ProfileModel) -> DataFrame:
    return rows.select("patientId", "side", "measurement_id", first.probability().alias("p"))


def feature_rows(
    rows: DataFrame, sides: DataFrame, first: ProfileModel, contract: asymmetry.Contract = asymmetry.CURRENT,
    *, shared_axis: bool = False,
) -> DataFrame:
    """One feature row per scoring row: all rows of the side count, there is no biopsy filter."""
    profiles = asymmetry.side_profiles(rows, contract, shared_axis=shared_axis)
    pairs = asymmetry.pair_features(sides, profiles, contract)
    scores = cases.case_scores(sides, row_scores(rows, first))
    columns = [c for c in S.REPORT_METADATA if c in rows.columns]
    out = (
        sides.withColumns(
            {
                "target_side": X.side_display("target_side_norm"),
                "contralateral_side": X.side_display("contralateral_side_norm"),
            }
        )
        .join(cases.patient_rollup(rows), "patientId")
        .join(pairs, "target_case_id").join(scores, "target_case_id")
    )
    if columns:
        named = rows.withColumn("target_side_norm", X.side_norm("side")).where("target_side_norm is not null")
        out = out.join(filters.consensus(named, ["patientId", "target_side_norm"], columns),
                       ["patientId", "target_side_norm"], "left")
    # Features feed the target report, the opposite side and the percentiles: computed once.
    return cut_lineage(cases.reliability(out))


def neutral_gate(df: DataFrame) -> DataFrame:
    """Switch the paired refinement off where forced; profile and age evidence stay."""
    off = F.col("force_gate_off")
    return df.withColumns(
        {
            "symmetry_available": F.when(off, 0).otherwise(F.col("symmetry_available")),
            "result_reliability": F.when(off, "low").otherwise(F.col("result_reliability")),
            "result_reliability_reason": F.when(off, NEUTRAL_REASON).otherwise(F.col("result_reliability_reason")),
        }
    )


def score_sides(
    features: DataFrame, final: GatedLogisticModel, *, policy: tiers.TierPolicy, reference: DataFrame | None = None,
) -> DataFrame:
    """Probability, decision, tier and reference percentiles per scoring row."""
    policy.check()
    t = F.lit(float(policy.threshold))
    out = final.transform(neutral_gate(features))
    out = out.withColumns(
        {
            "decision_threshold": t,
            "biopsy_required": tiers.decision("p_cancer", t),
            "target_class_risk_level": tiers.risk_level("p_cancer", t),
            "tier": tiers.tier("p_cancer", t, F.lit(policy.borderline), F.lit(policy.outer)),
        }
    )
    if reference is not None:
        out = cut_lineage(metrics.score_percentiles(out, reference, p="p_cancer", y="label"))
    return out


def routed_score(features: DataFrame, paired: GatedLogisticModel, plain: GatedLogisticModel, thresholds: dict) -> DataFrame:
    """Older artifacts: the model and threshold depend on whether pairing is available."""
    on = F.col("symmetry_available") == 1
    a = paired.transform(features.where(on)).withColumns(
        {"model_route": F.lit("paired"), "threshold": F.lit(thresholds["paired"])}
    )
    b = plain.transform(features.where(~on)).withColumns(
        {"model_route": F.lit("fallback_no_symmetry"), "threshold": F.lit(thresholds["fallback_no_symmetry"])}
    )
    return a.unionByName(b)


def side_evidence(rows: DataFrame, sides: DataFrame, first: ProfileModel) -> DataFrame:
    """Every row probability of the scored sides, numbered by measurement: the complete evidence table."""
    scored = rows.select(
        "patientId", F.upper(X.side_exact("side")).alias("target_side_norm"), "measurement_id",
        first.probability().alias("p"),
    ).where("target_side_norm is not null")
    return sides.select("patientId", "target_side_norm", "target_case_id", "role").join(
        scored, ["patientId", "target_side_norm"]
    )


def report_id(identity: dict, case: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(identity["id"]), X.col(case)), 256).substr(1, 16)


def report_evidence(evidence: DataFrame, identity: dict) -> DataFrame:
    """All row probabilities behind the reports: (report_id, side, role, measurement_id, p).

    A report refers to its rows by report_id and side and says how many there are, whatever the size of a side.
    """
    asked = F.when(F.col("role") == "target", F.col("target_side_norm")).otherwise(X.other_side("target_side_norm"))
    return evidence.select(
        report_id(identity, cases.case_id(F.col("patientId"), asked)).alias("report_id"),
        F.lower("target_side_norm").alias("side"), "role", "measurement_id", X.report_number("p").alias("p"),
    )


def _text(c: Column | str, digits: int = 5) -> Column:
    """Number as text, or the placeholder."""
    return F.coalesce(X.report_number(c, digits).cast("string"), F.lit("unknown"))


def _meta(df: DataFrame, *names: str) -> Column:
    present = [n for n in names if n in df.columns]
    return X.first_text(*present) if present else F.lit("unknown")


def _scan_metadata(df: DataFrame) -> Column:
    has_age = F.col("age_available") == 1
    return F.struct(
        F.col("patientId").alias("patient_id"), F.lower("target_side").alias("target_side"),
        _text(F.when(has_age, F.col("age"))).alias("patient_age"), has_age.alias("patient_age_available"),
        _meta(df, "session_uid", "session_id").alias("session_id"),
        _meta(df, "scan_date_time", "started_at").alias("scan_date_time"),
        _meta(df, "operator_id").alias("operator_id"), _meta(df, "hardware_version").alias("hardware_version"),
        _meta(df, "eoscan_version").alias("eoscan_version"),
        _meta(df, "experimental_protocol_version", "product_protocol_version").alias("experimental_protocol_version"),
        _meta(df, "mammography_suspicious_field").alias("mammography_suspicious_field"),
        _meta(df, "mammography_conclusion").alias("mammography_conclusion"),
        F.struct(
            F.col("target_measurements").alias("target_valid_measurements"),
            (F.col("contralateral_measurements") > 0).alias("contralateral_available"),
            F.col("contralateral_measurements").alias("contralateral_valid_measurements"),
        ).alias("measurement_summary"),
    )


def _model_metrics(record: dict) -> Column:
    value = lambda k: _text(F.lit(record[k])) if record.get(k) is not None else F.lit("unknown")
    return F.struct(
        F.lit("train_on_all_target_breast_cases").alias("dataset"), F.lit("not_performed").alias("validation"),
        value("sensitivity").alias("sensitivity"), value("specificity").alias("specificity"),
    )


def report_time(utc: Column | None = None) -> Column:
    """A time in UTC without zone (default: now) as a Europe/Paris ISO text with offset."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")) if utc is None else utc
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Paris"), utc)
    minutes = F.timestamp_diff("MINUTE", utc, local)
    offset = F.format_string("+%02d:%02d", (minutes / 60).cast("int"), (minutes % 60).cast("int"))  # never west of UTC
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def external_report(scored: DataFrame, requests: DataFrame, *, record: dict, identity: dict, created_at: Column) -> DataFrame:
    """Flat report, one row per request."""
    target = scored.where("role = 'target'").join(
        requests.select("patientId", "target_side_norm", "analysis_author", "prediction_comment"),
        ["patientId", "target_side_norm"],
    )
    meta = _scan_metadata(target)
    return target.withColumn("_m", meta).select(
        F.lit("external_report").alias("output_type"), F.lit(identity["external_version"]).alias("report_version"),
        report_id(identity, "target_case_id").alias("report_id"),
        created_at.alias("created_at"), "analysis_author", "prediction_comment",
        F.col("patientId").alias("patient_id"), F.col("_m.patient_age").alias("patient_age"),
        F.lower("target_side").alias("target_side"),
        F.col("_m.mammography_suspicious_field").alias("mammography_suspicious_field"),
        F.col("_m.scan_date_time").alias("scan_date_time"), F.col("_m.operator_id").alias("operator_id"),
        F.col("_m.hardware_version").alias("hardware_version"), F.col("_m.eoscan_version").alias("eoscan_version"),
        F.lit(identity["name"]).alias("model_name"), F.lit(identity["version"]).alias("model_version"),
        _model_metrics(record).alias("model_metrics"),
        X.report_number("p_cancer").alias("risk_probability"), "target_class_risk_level",
        X.report_number("decision_threshold").alias("decision_threshold"), "biopsy_required",
        F.col("result_reliability").alias("reliability"), F.col("result_reliability_reason").alias("reliability_reason"),
    )


def _percentiles(known: Column) -> Column:
    pick = lambda c: F.when(known, _text(c)).otherwise(F.lit("unknown"))
    return F.struct(
        F.when(known, F.lit("train_on_all_target-breast_cases")).otherwise(F.lit("unknown")).alias("reference_population"),
        pick("percentile_all").alias("all"), pick("percentile_reference_class").alias("reference_class"),
        pick("percentile_target_class").alias("target_class"),
    )


def _breast(role: str) -> Column:
    known = F.col("target_case_id").isNotNull()
    word = lambda c: F.coalesce(c, F.lit("unknown"))
    paired = F.col("symmetry_available") == 1
    final = [
        _text("p_cancer").alias("p_cancer"), F.lit("BENIGN").alias("reference_class"), F.lit("CANCER").alias("target_class"),
    ]
    if role == "target":
        final += [F.col("target_class_risk_level"), F.col("biopsy_required")]
    final += [
        word(F.concat(F.lit("TRA "), F.col("tier").cast("string"))).alias("level"),
        _percentiles(known).alias("score_percentiles"),
    ]
    parts = [
        known.alias("available"), word(F.lower("target_side")).alias("side"),
        F.struct(
            _text("profile_p_cancer_logit_average").alias("p_cancer"),
            F.struct(
                F.when(known, F.col("_report_id")).alias("report_id"), word(F.lower("target_side")).alias("side"),
                F.coalesce(F.col("profile_p_cancer_n_measurements"), F.lit(0)).cast("long").alias("rows"),
            ).alias("measurement_evidence"),
        ).alias("azimuthal_integration_profile"),
        F.struct(*final).alias("final_prediction"),
        F.struct(word(F.col("result_reliability")).alias("level"),
                 word(F.col("result_reliability_reason")).alias("reason")).alias("reliability"),
        F.struct(F.coalesce(paired, F.lit(False)).alias("available")).alias("symmetry"),
        F.struct(
            F.when(~known, "unknown").when(paired, "azimuthal_integration_age_with_symmetry")
            .otherwise("azimuthal_integration_age").alias("scoring_path")
        ).alias("model_execution"),
    ]
    if role == "contralateral":
        parts.append(F.when(~known, MISSING_REASON).alias("reason"))
    return F.struct(*parts)


def internal_report(scored: DataFrame, requests: DataFrame, *, record: dict, identity: dict, created_at: Column) -> DataFrame:
    """Nested report with both breasts; an absent contralateral side is filled with placeholders.

    Row probabilities are rows of ``report_evidence``; the report holds their key and number.
    """
    asked_side = F.when(F.col("role") == "target", F.col("target_side_norm")).otherwise(F.col("contralateral_side_norm"))
    full = scored.withColumn("_report_id", report_id(identity, cases.case_id(F.col("patientId"), asked_side)))
    target = full.where("role = 'target'").withColumns(
        {"scan_metadata": _scan_metadata(full), "target": _breast("target")}
    ).select(
        "patientId", F.col("target_side_norm").alias("_side"), F.col("target_case_id").alias("_case"),
        "decision_threshold", "scan_metadata", "target",
    )
    asked = requests.where("status = 'ok'").select(
        "patientId", F.col("target_side_norm").alias("_side"), "analysis_author", "prediction_comment"
    )
    # The other side's scoring row carries the requested side as its opposite.
    other = full.where("role = 'contralateral'").withColumn("_side", F.col("contralateral_side_norm")).drop(
        "decision_threshold", "role"
    )
    out = target.join(asked, ["patientId", "_side"]).join(other, ["patientId", "_side"], "left")
    return out.withColumn("contralateral", _breast("contralateral")).select(
        F.lit("internal_clinical_report").alias("output_type"),
        F.lit(identity["internal_version"]).alias("report_version"),
        report_id(identity, "_case").alias("report_id"),
        created_at.alias("created_at"), "analysis_author", "prediction_comment",
        F.struct(
            F.lit(identity["id"]).alias("id"), F.lit(identity["name"]).alias("name"),
            F.lit(identity["version"]).alias("version"), F.lit(identity["sha256"]).alias("artifact_sha256"),
        ).alias("model"),
        _model_metrics(record).alias("model_metrics"),
        F.struct(
            F.lit("target_sensitivity_0.95").alias("threshold_id"),
            X.report_number("decision_threshold").alias("threshold"),
            F.array(F.lit("target.final_prediction")).alias("applies_to"),
        ).alias("decision_threshold"),
        "scan_metadata", F.struct("target", "contralateral").alias("breast_predictions"),
    )
