"""Registered queries: one per inventory id, over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import resampling as R
from ..functions import scalars as X
from .. import schemas as S
from ..operators import asymmetry, audits, calibration, cases, filters, folds, metrics, ordered, signal, tiers
from ..operators.filters import Predicate
from ..sources import reference, storage
from . import views as V

QUERIES: dict = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Result rounding; -0.0 becomes 0.0."""
    out = F.round(X.col(c), digits) + F.lit(0.0)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def points(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(key, F.posexplode(column).alias("i", "v")).select(key, F.col("i"), r6("v"))


# --- A: scans, sources, sinks ------------------------------------------------------------------


@query("a1_measurement_scan")
def _(spark, sf):
    df = filters.where_all(V.measurements(spark, sf), [r for r in V.quality_rules() if r.op != ">"])
    return df.select(
        "measurement_id", "patientId", "side", "position", "sample_thickness_mm", "calibrant_thickness_mm",
        F.size("q_range").alias("points"), r6(P.total(F.col("radial_profile_data")), "profile_sum"),
    )


@query("a2_session_catalogue")
def _(spark, sf):
    return calibration.session_catalogue(V.calibration_sets(spark, sf))


@query("a3_calibration_manifest")
def _(spark, sf):
    m = calibration.in_manifest_order(calibration.manifest(V.calibration_sets(spark, sf)))
    return m.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


@query("a4_batch_rules_json")
def _(spark, sf):
    path = storage.new_path(spark, "batch-rules")
    doc = reference.batch_rules(spark).agg(F.collect_list(F.struct(*S.BATCH_RULE.names)).alias("batch_table"))
    storage.write_json(doc, path)  # eight rules, one document
    rules = storage.read_batch_rules(spark, path).withColumnRenamed("data_batch", "rule_batch")
    used = calibration.manifest(V.calibration_sets(spark, sf)).groupBy("data_batch").agg(F.count(F.lit(1)).alias("sets"))
    return used.join(rules, F.col("data_batch").eqNullSafe(F.col("rule_batch")), "left").select(
        "data_batch", "sets", F.col("source_line"), F.col("kbeta_absent"), "calibrant_thickness_mm"
    )


@query("a5_csv_export")
def _(spark, sf):
    out = metrics.pool_cases(V.oof(spark, sf)).select(
        "target_case_id", "patientId", "label", r6("p_cancer", digits=9), r6("threshold_target")
    )
    path = storage.write_csv(out, storage.new_path(spark, "csv"))
    return spark.read.schema(out.schema).option("header", True).csv(path)


@query("a6_artifact_lineage")
def _(spark, sf):
    rows = V.gated(spark, sf).select("measurement_id", "patientId", "product_status_group", "radial_profile_data")
    path = storage.write_artifact(
        rows, storage.new_path(spark, "artifact"), config_text=json.dumps({"gate": V.VIEW_GATE}),
        input_sha256=storage.input_sha256(spark, f"{sf}/embeddings.parquet"),
    )
    return storage.read_artifact(spark, path).select(
        "measurement_id", "patientId", "product_status_group", r6(P.total(F.col("radial_profile_data")), "profile_sum")
    )


@query("a7_text_checksums")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", storage.text_checksum(F.col("text")).alias("sha256"))


@query("a7_file_digests")
def _(spark, sf):
    """Digests of files that Spark wrote from the customer table, one file for each nation."""
    sums = V.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("s"))
    path = storage.new_path(spark, "text")
    sums.select("c_nationkey", F.concat_ws(",", "c_nationkey", "n", "s").alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    files = storage.file_checksums(spark, f"{path}/c_nationkey=*")
    return files.select(F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("int").alias("nation"), "length", "sha256")


@query("a10_exclusion_lists")
def _(spark, sf):
    lists = reference.exclusion_lists(spark, V.EXCLUDED_IDS, V.EXCLUDED_DAYS)
    m = V.measurements(spark, sf)
    hits = m.select(
        F.when(F.col("linked_agbh_session_uid").isNotNull(), "linked_agbh_session_uid").otherwise("started_at").alias("kind"),
        F.coalesce("linked_agbh_session_uid", F.col("started_on").cast("string")).alias("value"),
    ).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return lists.join(hits, ["kind", "value"], "left").select("kind", "value", F.coalesce("n", F.lit(0)).alias("rows"))


# --- B: filters, predicates, projections -------------------------------------------------------

IDS = ("measurement_id", "patientId", "position")


@query("b1_predicates")
def _(spark, sf):
    rules = [
        Predicate("side", "==", value="Left"), Predicate("position", "in", values=("P1", "P2")),
        Predicate("position", "not in", values=("P1",)), Predicate("sample_thickness_mm", ">", value=50.0),
        Predicate("sample_thickness_mm", ">=", value=50.0), Predicate("sample_thickness_mm", "<=", value=50.0),
        Predicate("calibrant_thickness_mm", "between", lower=2.0, upper=40.0), Predicate("age", "notna"),
        Predicate("started_on", "date>=", value="2025-03-01"),
        Predicate("started_on", "date in", values=("2025-02-06", "2025-02-14")),
        Predicate("started_on", "date not in", values=("2025-02-06", "2025-02-14")),
    ]
    counts = F.array(
        *[F.struct(F.lit(r.op).alias("op"), F.count_if(filters.predicate(r)).alias("n")) for r in rules]
    )
    return V.measurements(spark, sf).agg(counts.alias("z")).select(F.inline("z"))


@query("b2_exclusion_fallback")
def _(spark, sf):
    df = filters.exclude_sessions(V.measurements(spark, sf), V.EXCLUDED_IDS, V.EXCLUDED_DAYS)
    return df.select(*IDS, "linked_agbh_session_uid", F.col("started_on").cast("string").alias("started_on"))


def _filtered(name: str, *rules: Predicate, extra: tuple[str, ...] = ()):
    @query(name)
    def _(spark, sf):
        return filters.where_all(V.measurements(spark, sf), rules).select(*IDS, *extra)


_filtered("b3_position_filter", Predicate("position", "in", values=S.POSITIONS))
_filtered("b4_sample_thickness", Predicate("sample_thickness_mm", "notna"),
          Predicate("sample_thickness_mm", ">", value=0.0), extra=("sample_thickness_mm",))
_filtered("b5_calibrant_thickness", Predicate("calibrant_thickness_mm", "between", lower=2.0, upper=40.0),
          extra=("calibrant_thickness_mm",))
_filtered("b6_q_coverage", Predicate("poni_q_max_nm_inv", ">=", value=23.0), extra=("poni_q_max_nm_inv",))
_filtered("b9_specimen_status", Predicate("specimen_status", "in", values=S.STATUS_KEEP), extra=("specimen_status",))


@query("b7_biopsy_rows")
def _(spark, sf):
    return V.measurements(spark, sf).where(X.as_flag("biopsy")).select(*IDS)


@query("b8_group_filter")
def _(spark, sf):
    df = V.measurements(spark, sf)
    return filters.keep_groups_with(df, "patientId", df["biopsy"]).select(*IDS)


@query("b10_label_filter_stats")
def _(spark, sf):
    return filters.label_filter_stats(filters.label_columns(V.measurements(spark, sf), with_patient=False))


RAW_FLAG = "case event_id%7 when 0 then 'TRUE' when 1 then 'yes' when 2 then '1' when 3 then '1.0' when 4 then 'no' when 5 then '' end"


@query("b11_boolean_coercion")
def _(spark, sf):
    df = V.table(spark, sf, "events").selectExpr(f"{RAW_FLAG} raw", "cast(event_id%2 as double) num")
    return df.groupBy(F.col("raw"), X.as_flag("raw").alias("flag"), X.as_flag("num").alias("num_flag")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("b12_pair_filter")
def _(spark, sf):
    df = filters.label_columns(V.measurements(spark, sf), with_patient=False)
    return filters.keep_label_pairs(df, [("BENIGN", "CANCER")]).select(*IDS, "product_status_group")


@query("b13_specimen_validity")
def _(spark, sf):
    df = filters.where_all(V.measurements(spark, sf), V.quality_rules())
    return filters.specimen_validity(df, min_measurements=2, min_specimens=2).select(*IDS, "specimenId", "specimen_measurement_count")


RAW_SIDE = (
    "case event_id%8 when 0 then 'Left' when 1 then ' right ' when 2 then 'L' when 3 then 'LEFT breast' "
    "when 4 then 'r' when 5 then '' when 6 then 'centre' end"
)


@query("b14_side_normalisation")
def _(spark, sf):
    df = V.table(spark, sf, "events").selectExpr(f"{RAW_SIDE} raw").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return df.select("raw", "n", X.side_norm("raw").alias("side_norm"), X.side_display(X.side_norm("raw")).alias("side_display"))


@query("b15_side_exact")
def _(spark, sf):
    df = V.table(spark, sf, "events").selectExpr(f"{RAW_SIDE} raw").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return df.select("raw", "n", X.side_exact("raw").alias("side_exact"))


@query("b16_label_grouping")
def _(spark, sf):
    return filters.label_columns(V.measurements(spark, sf)).select(
        *IDS, "product_status_group", "product_diagnosis", "patient_product_diagnosis"
    )


@query("b17_binary_label")
def _(spark, sf):
    df = filters.label_columns(V.measurements(spark, sf), with_patient=False)
    return df.select("measurement_id", X.binary_label("product_status_group").alias("label"))


@query("b18_stage1_rows")
def _(spark, sf):
    return filters.stage1_guard(filters.stage1_rows(V.gated(spark, sf)))


@query("b19_keep_columns")
def _(spark, sf):
    df = filters.label_columns(V.measurements(spark, sf))
    wanted = [c for c in S.TRAINING_COLUMNS if c not in ("q_range", "radial_profile_data")] + ["measurement_id"]
    return filters.keep_columns(df, wanted, "ignore")


@query("b21_numeric_coercion")
def _(spark, sf):
    df = V.measurements(spark, sf).selectExpr(
        "patientId", "case when measurement_id%5=4 then 'n/a' else cast(cast(age as int) as string) end raw"
    )
    v = X.to_number("raw")
    return df.groupBy("patientId").agg(
        F.coalesce(F.median(v), F.lit(0.0)).alias("median"), F.max(v.isNotNull()).alias("has_numeric")
    )


META_ROWS = (
    "measurement_id", "patientId", "side",
    "case when measurement_id%4=3 then '  ' else 'op'||cast(measurement_id div 6%3 as string) end operator_id",
    "case when measurement_id%9=0 then 'hw2' else 'hw1' end hardware_version",
    "cast(null as string) eoscan_version",
)


@query("b22_consensus_metadata")
def _(spark, sf):
    df = V.measurements(spark, sf).selectExpr(*META_ROWS)
    return filters.consensus(df, ["patientId", "side"], ["operator_id", "hardware_version", "eoscan_version"])


@query("b23_first_text")
def _(spark, sf):
    df = V.measurements(spark, sf).selectExpr(
        "measurement_id", "case when measurement_id%3=0 then '  ' when measurement_id%3=1 then 'uid' end a",
        "case when measurement_id%2=0 then ' sid ' end b",
    )
    return df.select("measurement_id", X.first_text("a", "b").alias("value"))


ODD = "case when event_id%9=8 then double('NaN') when event_id%9=7 then double('Infinity') when event_id%9=6 then null else value/7e0 end v"


@query("b24_report_rounding")
def _(spark, sf):
    # Every fifth value is an exact tie of the fifth digit.
    rows = V.table(spark, sf, "events").selectExpr("event_id", ODD).select(
        "event_id", F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 4001 - 2000) / 64.0).otherwise(F.col("v")).alias("v"))
    return rows.select("event_id", X.report_number("v").alias("v"))


def _manifest(spark, sf):
    return calibration.manifest(V.calibration_sets(spark, sf))


BATCHES = ("3", "4", "5", "7", "2")


@query("b25_calibrant_selection")
def _(spark, sf):
    return calibration.select_calibrants(_manifest(spark, sf), BATCHES).select(
        "session_uid", "data_batch", "measurement_type_name"
    )


@query("b26_distance_filter")
def _(spark, sf):
    return calibration.distance_stats(_manifest(spark, sf), 200.0)


CONTAINERS = (
    "o_custkey container_id",
    "case when o_orderkey%97=0 then 'X' when o_orderkey%5=0 then ' ' else 'K'||cast(o_custkey as string) end set_patient_id",
    "case when o_custkey%3<>0 then 'K'||cast(o_custkey as string) end sample_patient_name",
    "case when o_custkey%41=0 then '0.2' else '0.3' end schema_version",
    "case when o_custkey%43=0 then null else 'xrd-session' end format",
    "case when o_custkey%37=0 then 'other' else 'K'||cast(o_custkey as string) end expected_patient_id",
)


@query("b27_container_check")
def _(spark, sf):
    df = V.table(spark, sf, "orders").selectExpr(*CONTAINERS)
    return filters.container_violations(df, schema_version="0.3", fmt="xrd-session")


@query("b28_patient_id_fallback")
def _(spark, sf):
    df = V.table(spark, sf, "orders").selectExpr(*CONTAINERS)
    pid = F.coalesce(X.non_blank("set_patient_id"), X.non_blank("sample_patient_name"))
    return df.groupBy(pid.alias("patient_id")).agg(F.count(F.lit(1)).alias("n"))


@query("b29_finite_or_zero")
def _(spark, sf):
    return V.table(spark, sf, "events").selectExpr("event_id", ODD).select("event_id", r6(X.finite_or_zero("v"), "v"))


# --- C: profile and signal operators -----------------------------------------------------------

PONI = (
    "'Distance: 0.'||lpad(cast(15+measurement_id%10 as string),2,'0')||'\\n'||'Poni1: 0.01\\nPoni2: 0.02\\n'||"
    "'PixelSize1: 5.5e-05\\nPixelSize2: 5.5e-05\\nWavelength: 5.6e-11\\nRows: 512\\nColumns: 768'"
)


@query("c1_geometry")
def _(spark, sf):
    df = V.measurements(spark, sf).selectExpr("measurement_id", f"{PONI} ponifile")
    return signal.geometry(df).select("measurement_id", r6("distance_m"), r6("poni_q_max"))


@query("c2_faulty_pixels")
def _(spark, sf):
    px = signal.faulty_pixels(V.pixels(spark, sf), counts="bright")
    return px.groupBy("measurement_id").agg(F.count_if("faulty").alias("faulty"), F.count(F.lit(1)).alias("pixels"))


@query("c3_q_bins")
def _(spark, sf):
    b = signal.q_bin(F.col("q"), 2.0, 23.0, 100)
    return V.pixels(spark, sf).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("q"), "mean_q"))


def _bins(spark, sf, mask="faulty"):
    return signal.azimuthal_bins(signal.faulty_pixels(V.pixels(spark, sf), counts="bright"), mask=mask)


@query("c4_azimuthal_integration")
def _(spark, sf):
    return _bins(spark, sf).select("measurement_id", "bin", r6("intensity"), r6("sigma"), "pixels")


@query("c5_thickness_correction")
def _(spark, sf):
    df = signal.thickness_correct(V.measurements(spark, sf))
    return df.select(
        "measurement_id", r6("thickness_factor"), "thickness_adjusted",
        r6(P.total(F.col("radial_profile_data")), "profile_sum"),
    )


def _snr(spark, sf):
    df = signal.profiles_from_bins(_bins(spark, sf))
    return df.select("measurement_id", signal.snr_db("radial_profile_data", "sigma").alias("snr_db"))


@query("c6_snr")
def _(spark, sf):
    return _snr(spark, sf).select("measurement_id", r6("snr_db"))


@query("c7_snr_gate")
def _(spark, sf):
    return signal.snr_filter(_snr(spark, sf), 15.0).select("measurement_id", r6("snr_db"))


@query("c8_band_normalisation")
def _(spark, sf):
    df = signal.band_normalise(V.measurements(spark, sf), *V.VIEW_BAND, keep_raw=True)
    return df.select(
        "measurement_id", r6(P.median(P.finite_y("q_range", "radial_profile_data", *V.VIEW_BAND)), "band_median"),
        r6(P.total(F.col("radial_profile_data")), "profile_sum"),
        r6(P.total(F.col("radial_profile_data_raw")), "raw_sum"),
    )


@query("c9_profile_gate")
def _(spark, sf):
    return signal.profile_gate(V.normalised(spark, sf), threshold=V.VIEW_GATE).select(
        "measurement_id", r6("radial_profile_value_at_q"), r6("radial_profile_nearest_q_nm_inv"),
        r6("radial_profile_q_delta_nm_inv"), "radial_profile_value_pass",
    )


@query("c10_profile_check")
def _(spark, sf):
    return signal.profile_check(V.measurements(spark, sf))


@query("c11_roi_slice")
def _(spark, sf):
    q, y = P.roi_q("q_range", 6.7, 15.0), P.roi_y("q_range", "radial_profile_data", 6.7, 15.0)
    df = V.measurements(spark, sf).select("measurement_id", q.alias("q"), y.alias("y"))
    return df.select(
        "measurement_id", F.size("q").alias("n"), r6(F.array_min("q"), "q_lo"), r6(F.array_max("q"), "q_hi"),
        r6(P.total(F.col("y")), "y_sum"),
    )


@query("c12_smoothing")
def _(spark, sf):
    df = V.measurements(spark, sf).select("measurement_id", P.smooth("radial_profile_data").alias("s"))
    return points(df, "measurement_id", "s")


@query("c13_interpolation")
def _(spark, sf):
    df = V.measurements(spark, sf).select(
        "measurement_id", R.resample(1.0, 24.0, 47)("q_range", "radial_profile_data").alias("s")
    )
    return points(df, "measurement_id", "s")


@query("c14_near_minimum")
def _(spark, sf):
    df = V.measurements(spark, sf).select(
        "measurement_id", signal.near_minimum_normalise(F.col("q_range"), F.col("radial_profile_data")).alias("s")
    )
    return points(df, "measurement_id", "s")


@query("c15_min_max")
def _(spark, sf):
    df = V.measurements(spark, sf).select("measurement_id", P.min_max("radial_profile_data").alias("s"))
    return points(df, "measurement_id", "s")


@query("c16_heat_map")
def _(spark, sf):
    df = signal.heat_map(V.calibration_profiles(spark, sf), 3.0, 21.0, 37)
    out = df.select("vec_id", F.col("started_on").cast("string").alias("day"), F.posexplode("heat").alias("i", "v"))
    return out.select("vec_id", "day", "i", r6("v")).orderBy("day", "vec_id", "i")


@query("c17_peak_value")
def _(spark, sf):
    return V.measurements(spark, sf).select(
        "measurement_id", r6(P.peak_value("q_range", "radial_profile_data", 13.0, 14.8), "peak"),
        r6(P.peak_value("q_range", "radial_profile_data", 13.0, 13.5), "narrow_peak"),
    )


@query("c18_peak_height")
def _(spark, sf):
    return signal.peak_height(V.measurements(spark, sf), 14.0, 0.5).select("measurement_id", r6("peak_height"))


def _sides(spark, sf, contract=asymmetry.CURRENT):
    return asymmetry.side_profiles(V.gated(spark, sf), contract, shared_axis=True)


@query("c19_side_profiles")
def _(spark, sf):
    df = _sides(spark, sf).select("patientId", "side_norm", F.explode(F.arrays_zip("q1", "mu", "sd")).alias("z"))
    return df.select("patientId", "side_norm", r6("z.q1", "q"), r6("z.mu", "mu"), r6("z.sd", "sd"))


@query("c20_trapezoid")
def _(spark, sf):
    resid = F.transform("radial_profile_data", lambda v: F.greatest(v - 3.0, F.lit(0.0)))
    return V.measurements(spark, sf).select("measurement_id", r6(P.trapezoid("q_range", resid), "area"))


# --- D: paired features ------------------------------------------------------------------------


def _pairs(spark, sf, contract=asymmetry.CURRENT):
    """All profiles of the view share one q axis, as after fixed-range integration."""
    g = V.gated(spark, sf)
    sides = asymmetry.side_profiles(g, contract, shared_axis=True)
    return asymmetry.pair_features(V.target_cases(g), sides, contract)


def _pair_query(name: str, *columns: str):
    @query(name)
    def _(spark, sf):
        return _pairs(spark, sf).select("target_case_id", *[r6(c) for c in columns])


_pair_query("d1_mean_rms", "sk_meanrms1", "sk_meanrms2")
_pair_query("d2_weighted_rms", "sk_weightedrms1", "sk_weightedrms2")
_pair_query("d3_replicate_sigma", "sk_sigma_target1", "sk_sigma_contralateral1", "sk_sigma_target2", "sk_sigma_contralateral2")
_pair_query("d4_mahalanobis", "sk_mahalanobis1", "sk_mahalanobis2")
_pair_query("d5_peak14_delta", "sk_peak14_intensity_abs_delta")
_pair_query("d6_mean_peak_delta", "sk_mean_peak_value_abs_delta")
_pair_query("d7_wasserstein_roi", "sk_wasserstein_distance_mu_tc")
_pair_query("d8_wasserstein_full", "sk_wasserstein_distance_full_q2")
_pair_query("d9_cosine_full", "sk_cosine_distance_full_q2")
_pair_query("d10_within_cosine", "target_within_cosine_distance_mean", "contralateral_within_cosine_distance_mean")
_pair_query("d11_between_cosine", "between_breasts_cosine_distance_mean", "symmetry_cosine_score")


@query("d12_availability_gate")
def _(spark, sf):
    return _pairs(spark, sf).select(
        "target_case_id", "symmetry_available", "symmetry_reason", "target_measurements", "contralateral_measurements",
        *[r6(c) for c in S.CORE4],
    )


@query("d13_legacy_contract")
def _(spark, sf):
    return _pairs(spark, sf, asymmetry.LEGACY).select(
        "target_case_id", "symmetry_available", *[r6(c) for c in S.PAIR_FEATURES]
    )


# --- E: aggregations ---------------------------------------------------------------------------


@query("e1_target_cases")
def _(spark, sf):
    return V.target_cases(V.gated(spark, sf))


def _row_scores(spark, sf, rows=None):
    """Deterministic stand-in for first-stage probabilities."""
    g = rows if rows is not None else V.gated(spark, sf)
    return g.withColumn("p", X.clip(F.col("radial_profile_value_at_q") / 3.0, 0.01, 0.99))


@query("e2_logit_average")
def _(spark, sf):
    rows = _row_scores(spark, sf)
    return rows.groupBy("patientId", X.side_norm("side").alias("side_norm")).agg(
        r6(cases.logit_average(F.col("p")), "p"), F.count("p").alias("n")
    )


def _case_scores(spark, sf):
    g = V.gated(spark, sf)
    return cases.case_scores(V.target_cases(g), _row_scores(spark, sf, filters.stage1_rows(g)))


@query("e3_case_scores")
def _(spark, sf):
    return _case_scores(spark, sf).select(
        "target_case_id", r6("profile_p_cancer_probability_mean"), r6("profile_p_cancer_logit_average"),
        "profile_p_cancer_n_measurements",
    )


@query("e4_patient_rollup")
def _(spark, sf):
    return cases.patient_rollup(V.gated(spark, sf))


def _features(spark, sf):
    g = storage.cut_lineage(V.gated(spark, sf))
    t = V.target_cases(g)
    pairs = asymmetry.pair_features(t, asymmetry.side_profiles(g, shared_axis=True))
    scores = cases.case_scores(t, _row_scores(spark, sf, filters.stage1_rows(g)))
    # Used by several queries more than once; one small row per case.
    return cases.feature_table(t, cases.patient_rollup(g), pairs, scores)


@query("e5_reliability")
def _(spark, sf):
    return _features(spark, sf).select(
        "target_case_id", "min_measurements_per_breast", "target_measurements_ok", "contralateral_measurements_ok",
        "paired_measurements_ok", "profile_measurements_ok", "result_reliability", "result_reliability_reason",
    )


@query("e6_cohort_summary")
def _(spark, sf):
    return cases.cohort_summary(filters.label_columns(V.measurements(spark, sf), with_patient=False))


@query("e7_dataset_summary")
def _(spark, sf):
    g = V.gated(spark, sf)
    return cases.dataset_summary(g, V.target_cases(g))


def _scored_manifest(spark, sf):
    m = _manifest(spark, sf).withColumn("score", F.col("distance_mm") / 1e4)
    return m.withColumn("pass", F.coalesce(F.col("score") <= calibration.MAX_SCORE, F.lit(False)))


@query("e8_batch_scores")
def _(spark, sf):
    out = calibration.score_summary(_scored_manifest(spark, sf))
    return out.select(
        "data_batch", "n", "accepted", "rejected", *[r6(f"score_{k}") for k in ("min", "median", "mean", "max")]
    )


def _fold_metrics(spark, sf):
    df = V.oof(spark, sf).select(
        F.lit("model").alias("model_name"), "split_id", F.col("label").alias("y"), F.col("p_cancer").alias("p"),
        "threshold_target",
    )
    m = metrics.all_metrics(df, ["model_name", "split_id"], threshold=F.col("threshold_target"), with_calibration=False)
    names = ("sensitivity", "specificity", "balanced_accuracy", "ppv", "npv", "tp", "tn", "fp", "fn")
    return m.withColumnsRenamed({c: f"{c}_target" for c in names})


@query("e9_fold_summary")
def _(spark, sf):
    out = metrics.summarise_splits(_fold_metrics(spark, sf))
    return out.select("model_name", "splits", *[r6(c) for c in out.columns[2:]])


@query("e10_oof_pooling")
def _(spark, sf):
    return metrics.pool_cases(V.oof(spark, sf)).select(
        "target_case_id", "patientId", "label", r6("p_cancer", digits=9), r6("threshold_target")
    )


@query("e11_decision_stability")
def _(spark, sf):
    return tiers.stability(V.oof(spark, sf), F.lit(0.25)).select(
        "target_case_id", r6("p_cancer", digits=9), r6("decision_stability"), r6("margin")
    )


@query("e12_availability_warnings")
def _(spark, sf):
    return cases.availability_warnings(_features(spark, sf))


@query("e13_selection_lists")
def _(spark, sf):
    return calibration.selection_lists(_scored_manifest(spark, sf))


@query("e14_run_counts")
def _(spark, sf):
    m = _manifest(spark, sf)
    chosen = calibration.select_calibrants(m, BATCHES)
    return calibration.run_counts(
        m, chosen, calibration.within_distance(chosen, 200.0), calibration.latest_k(chosen, "2024-01-20", 2)
    )


def _reference_profiles(spark, sf):
    """The two highest ids of batch 7; the top-k is kept per task and merged."""
    return V.calibration_profiles(spark, sf).where("data_batch = '7'").orderBy(F.desc("vec_id")).limit(2)


@query("e15_reference_curve")
def _(spark, sf):
    return calibration.reference_curve(_reference_profiles(spark, sf), 2.0, 23.0, 200).select("i", r6("ref"))


# --- F: joins ----------------------------------------------------------------------------------


@query("f1_features_with_scores")
def _(spark, sf):
    return _features(spark, sf).select(
        "target_case_id", "label", "age", "measurements", r6("profile_p_cancer_logit_average"), r6("sk_weightedrms1")
    )


@query("f2_summary_with_intervals")
def _(spark, sf):
    long = lambda d, a: d.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}{a}").alias("value")) for m in ("roc_auc", "pr_auc", "brier_score", "log_loss")])))
    rows = storage.cut_lineage(_fold_metrics(spark, sf))  # a row for each split
    summary = long(metrics.summarise_splits(rows), "_mean")
    per = rows.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("roc_auc", "brier_score")])))
    band = per.groupBy("metric").agg(F.percentile("v", 0.025).alias("ci_low"), F.percentile("v", 0.975).alias("ci_high"))
    return folds.summary_with_intervals(summary, band).select("metric", r6("value"), r6("ci_low"), r6("ci_high"))


FOLDS, REPEATS, SEED = 5, 20, 42


def _members(spark, sf, repeats=REPEATS):
    assigned = folds.assign_folds(V.target_cases(V.gated(spark, sf)), folds=FOLDS, repeats=repeats, seed=SEED)
    return folds.split_members(assigned, folds=FOLDS)


@query("f3_fold_membership")
def _(spark, sf):
    rows = storage.cut_lineage(V.gated(spark, sf).select("patientId", "measurement_id", "side", "biopsy", "product_status_group"))
    assigned = folds.assign_folds(V.target_cases(rows), folds=FOLDS, repeats=REPEATS, seed=SEED)
    return folds.split_sums(rows, assigned, {"rows": F.lit(1), "id_sum": F.col("measurement_id")}, folds=FOLDS)


@query("f4_manifest_enrichment")
def _(spark, sf):
    m = calibration.effective_thickness(_manifest(spark, sf), change="2024-01-15")
    frames = V.table(spark, sf, "events").selectExpr(
        "event_id", "'/cal/'||cast(event_id - event_id%2 as string)||'.h5' file_path"
    )
    return calibration.enrich(frames, m).select(
        "event_id", "file_path", "data_batch", "source_line", "nova_range", "file_name", "distance_mm",
        "agbh_calibrant_thickness_mm",
    )


@query("f5_side_pairing")
def _(spark, sf):
    return cases.paired_sides(V.gated(spark, sf)).select(
        "patientId", "side_norm", "side_rows", "contralateral_side_norm", "contralateral_rows"
    )


@query("f6_within_side_pairs")
def _(spark, sf):
    s = _sides(spark, sf)
    return s.select(
        "patientId", "side_norm", (F.col("n_unit") * (F.col("n_unit") - 1) / 2).cast("bigint").alias("pairs"),
        r6(asymmetry.within_cosine("unit", "n_unit"), "mean_distance"),
    )


@query("f7_effective_thickness")
def _(spark, sf):
    return calibration.effective_thickness(_manifest(spark, sf), change="2024-01-15").select(
        "session_uid", "agbh_calibrant_thickness_mm", "agbh_calibrant_thickness_rule"
    )


def _boot_cases(spark, sf):
    g = V.gated(spark, sf)
    t = V.target_cases(g)
    s = cases.case_scores(t, _row_scores(spark, sf, filters.stage1_rows(g)))
    return storage.cut_lineage(t.join(s, "target_case_id").select(
        "target_case_id", "patientId", "label", F.col("profile_p_cancer_logit_average").alias("p_cancer"),
        F.lit(0.3).alias("threshold_target"),
    ))


BOOT = 2000


@query("f8_bootstrap_join")
def _(spark, sf):
    c = _boot_cases(spark, sf)
    drawn = folds.bootstrap_cases(c, folds.bootstrap_weights(c, replicates=BOOT, seed=SEED))
    return drawn.groupBy("b").agg(
        F.sum("w").alias("cases"), F.sum(F.col("w") * F.col("label")).alias("positives"), F.count(F.lit(1)).alias("distinct_cases")
    )


# --- G: ordering, top-k, set operations --------------------------------------------------------


@query("g1_first_k_per_batch")
def _(spark, sf):
    return calibration.select_calibrants(_manifest(spark, sf), BATCHES, per_batch=7).select("data_batch", "session_uid", "file_name")


@query("g2_latest_k")
def _(spark, sf):
    chosen = calibration.select_calibrants(_manifest(spark, sf), ["7", "3"])
    return calibration.latest_k(chosen, "2024-01-20", 5).select("session_uid", "file_name")


@query("g3_worst_calibration")
def _(spark, sf):
    return calibration.worst(_scored_manifest(spark, sf).where("score is not null"), "score").select("session_uid", r6("score"))


@query("g4_score_percentiles")
def _(spark, sf):
    s = V.scores(spark, sf)
    asked = s.where("case_id % 3 = 0").select("case_id", "p")
    return metrics.score_percentiles(asked, s.where("case_id % 3 <> 0")).select(
        "case_id", r6("percentile_all"), r6("percentile_reference_class"), r6("percentile_target_class")
    )


@query("g5_reference_scores")
def _(spark, sf):
    return metrics.reference_scores(V.scores_tied(spark, sf)).select("population", r6("score"), "n")


@query("g6_stable_order")
def _(spark, sf):
    m = calibration.in_manifest_order(calibration.select_calibrants(_manifest(spark, sf), BATCHES))
    return m.select("file_name", "set_name", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query("g7_union_splits")
def _(spark, sf):
    # Splits of one table are one filter; a union of frames would read the table for each of them.
    out = V.oof(spark, sf).where(F.col("split_id").isin(*range(5)))
    return out.groupBy("split_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p_cancer"), "mean_p"))


@query("g8_leakage_check")
def _(spark, sf):
    # Membership with planted overlaps: some test patients are in the training part as well.
    members = _members(spark, sf)
    planted = members.where("role = 'test' and patientId like '%3'").withColumn("role", F.lit("train"))
    return folds.leakage(members.unionByName(planted))


# --- M: evaluation and decisions ---------------------------------------------------------------


@query("m3a_design_matrix")
def _(spark, sf):
    from ..operators import model

    f = storage.cut_lineage(_features(spark, sf))
    out = model.design_matrix(f, model.gated_statistics(f))
    names = list(model.design_columns(F.col))
    return out.select("target_case_id", *[r6(n) for n in names])


def _threshold_row(df: DataFrame) -> DataFrame:
    t = metrics.thresholds(metrics.roc_points(metrics.score_curve(df)))
    inf = lambda c: F.when(F.col(c) != float("inf"), F.col(c))
    return t.select(r6(inf("threshold_youden"), "threshold_youden"), r6(inf("threshold_target"), "threshold_target"), "target_reached")


@query("m4_thresholds")
def _(spark, sf):
    return _threshold_row(V.scores(spark, sf))


@query("m4_thresholds_tied")
def _(spark, sf):
    return _threshold_row(V.scores_tied(spark, sf))


@query("m4_roc_points")
def _(spark, sf):
    return metrics.roc_points(metrics.score_curve(V.scores(spark, sf))).select(r6("threshold", digits=9), r6("tpr"), r6("fpr"))


@query("m5_roc_auc")
def _(spark, sf):
    return metrics.rank_metrics(metrics.score_curve(V.scores(spark, sf))).select(r6("roc_auc"))


@query("m5_roc_auc_tied")
def _(spark, sf):
    return metrics.rank_metrics(metrics.score_curve(V.scores_tied(spark, sf))).select(r6("roc_auc"))


@query("m6_average_precision")
def _(spark, sf):
    return metrics.rank_metrics(metrics.score_curve(V.scores(spark, sf))).select(r6("pr_auc"))


@query("m6_average_precision_tied")
def _(spark, sf):
    return metrics.rank_metrics(metrics.score_curve(V.scores_tied(spark, sf))).select(r6("pr_auc"))


@query("m7_confusion")
def _(spark, sf):
    m = metrics.confusion_metrics(V.oof(spark, sf), ["split_id"], y="label", p="p_cancer", threshold=F.col("threshold_target"))
    return m.select("split_id", "tp", "tn", "fp", "fn",
                    *[r6(c) for c in ("sensitivity", "specificity", "balanced_accuracy", "ppv", "npv")])


@query("m8_losses")
def _(spark, sf):
    return metrics.loss_metrics(V.oof(spark, sf), ["split_id"], y="label", p="p_cancer").select(
        "split_id", r6("brier_score"), r6("log_loss")
    )


@query("m9_calibration")
def _(spark, sf):
    return metrics.calibration(V.oof(spark, sf), ["split_id"], y="label", p="p_cancer").select(
        "split_id", r6("calibration_intercept"), r6("calibration_slope")
    )


@query("m11_folds")
def _(spark, sf):
    return folds.assign_folds(V.target_cases(V.gated(spark, sf)), folds=FOLDS, repeats=REPEATS, seed=SEED)


@query("m13_predictions")
def _(spark, sf):
    return metrics.prediction_frame(V.oof(spark, sf).drop("y_pred_target")).select(
        "target_case_id", "patientId", "label", "label_name", "split_id", r6("p_cancer", digits=9), r6("threshold_target"),
        "y_pred_target",
    )


@query("m14_bootstrap_intervals")
def _(spark, sf):
    reps = folds.bootstrap_metrics(_boot_cases(spark, sf), replicates=BOOT, seed=SEED)
    return folds.bootstrap_intervals(reps).select("metric", r6("ci_low"), r6("ci_high"), "replicates")


@query("m14_bootstrap_calibration")
def _(spark, sf):
    out = folds.bootstrap_calibration(_boot_cases(spark, sf), replicates=BOOT, seed=SEED)
    return out.select(*[r6(c) for c in out.columns])


@query("m15_decision")
def _(spark, sf):
    t = F.lit(0.25)
    return V.scores(spark, sf).select(
        "case_id", tiers.risk_level("p", t).alias("risk_level"), tiers.decision("p", t).alias("biopsy_required")
    )


@query("m16_tier_policy")
def _(spark, sf):
    out = tiers.tier_margins(tiers.stability(V.oof(spark, sf), F.lit(0.25)))
    return out.select("target_cases", "unstable_target_cases", "calibrated", r6("borderline_margin"), r6("outer_margin"))


@query("m17_tier_assignment")
def _(spark, sf):
    t = tiers.tier("p", F.lit(0.25), F.lit(0.5), F.lit(1.5))
    return V.scores(spark, sf).select("case_id", t.alias("tier"))


@query("m24_parameter_diff")
def _(spark, sf):
    base = V.measurements(spark, sf)
    p = base.groupBy(F.col("specimenId").alias("param"), F.col("position").alias("ix")).agg(
        F.max(F.get("radial_profile_data", F.lit(0))).alias("value")
    )
    p = p.select("param", "ix", F.when(F.col("ix") == "P4_R", F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    other = p.where("not (param like '%3_Left' and ix = 'P2')").withColumn(
        "value", F.when(F.col("param").like("%5_Right"), F.col("value") + 1e-3).otherwise(F.col("value") * (1.0 + 1e-14))
    )
    d = metrics.parameter_diff(p.where("not (param like '%7_Left' and ix = 'P1')"), other)
    return d.select("param", "ix", r6("left_value"), r6("right_value"), "status")


# --- K: calibration study ----------------------------------------------------------------------

STUDY = dict(q_min=2.0, q_max=23.0)


def _near(spark, sf, centres: DataFrame, half: float) -> DataFrame:
    """Profile points within ``half`` of each listed centre, counted and averaged over all profiles.

    The centre list has a few dozen rows given by the parameters, so it is the side that is sent to all tasks: points
    meet it by cells of the width ``half``, of which every centre touches three.
    """
    pts = V.calibration_profiles(spark, sf).select(F.explode(F.arrays_zip("q_range", "radial_profile_data")).alias("z"))
    pts = pts.select(F.col("z.q_range").alias("q"), F.col("z.radial_profile_data").alias("y"))
    per_q = pts.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    keys = list(centres.columns)
    cell = F.floor(F.col("centre") / half)
    touched = centres.distinct().withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    hit = per_q.withColumn("cell", F.floor(F.col("q") / half)).join(F.broadcast(touched), "cell")
    sums = hit.where(F.abs(F.col("q") - F.col("centre")) <= half).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return centres.join(sums, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("points"), (F.col("s") / F.col("n")).alias("mean_y"))


@query("k1_peak_positions")
def _(spark, sf):
    rows = [(k, "alpha", a) for k, a, _ in calibration.peaks(23.0)] + [(k, "beta", b) for k, _, b in calibration.peaks(23.0)]
    out = _near(spark, sf, spark.createDataFrame(rows, "ord int, kind string, centre double"), 0.17)
    return out.select("ord", "kind", r6("centre"), "points", r6("mean_y"))


@query("k2_peak_windows")
def _(spark, sf):
    rows = [(k, a, b, c, b) for k, a, b, c in calibration.peak_windows(2.0, 23.0)]
    out = _near(spark, sf, spark.createDataFrame(rows, "ord int, alpha_q double, beta_q double, right_control_q double, centre double"), 0.12)
    return out.select("ord", r6("alpha_q"), r6("beta_q"), r6("right_control_q"), "points", r6("mean_y"))


@query("k3_fit_mask")
def _(spark, sf):
    grid = calibration.grid_rows(2.0, 23.0, 1800)
    mask = calibration.fit_mask(grid, 2.0, 23.0)
    out = calibration.mask_mean(V.calibration_profiles(spark, sf), mask, 2.0, 23.0)
    return out.where("fit_mean is not null").select("vec_id", "fit_points", r6("fit_mean"))


@query("k4_fixed_shoulder")
def _(spark, sf):
    out = calibration.shoulder_metric(
        V.calibration_profiles(spark, sf), _reference_profiles(spark, sf), shoulder=(8.0, 9.5), points=500, **STUDY
    )
    return out.select("vec_id", *[r6(c) for c in out.columns[1:]])


@query("k5_reference_fit")
def _(spark, sf):
    out = calibration.left_shoulder_metric(
        V.calibration_profiles(spark, sf), _reference_profiles(spark, sf),
        shifts=(-0.05, -0.025, 0.0, 0.025, 0.05), points=1800, fits_only=True, **STUDY,
    )
    return out.select("vec_id", *[r6(c) for c in out.columns[1:]])


def _left_shoulder(spark, sf, details=False):
    return calibration.left_shoulder_metric(
        V.calibration_profiles(spark, sf), _reference_profiles(spark, sf), points=1800, with_details=details, **STUDY
    )


@query("k6_left_shoulder")
def _(spark, sf):
    return _left_shoulder(spark, sf).select(
        "vec_id", "session_uid", "data_batch", *[r6(c) for c in (
            "kbeta_left_positive_area", "right_control_positive_area", "kbeta_left_net_area", "kbeta_left_mean_net_residual",
            "reference_fit_scale", "reference_fit_offset", "reference_fit_linear_background")],
        "n_kbeta_windows", "window_orders",
    )


@query("k6_window_details")
def _(spark, sf):
    return _left_shoulder(spark, sf, True).select("vec_id", "peak_window_details")


@query("k6_window_rows")
def _(spark, sf):
    each = _left_shoulder(spark, sf, True).select("vec_id", F.inline("peak_windows"))
    return each.select("vec_id", "ord", *[r6(c) for c in ("alpha_q", "beta_q", "right_control_q", "left_area", "right_control_area")])


@query("k7_pass_fail")
def _(spark, sf):
    return calibration.pass_fail(_left_shoulder(spark, sf)).select(
        "vec_id", r6("agbh_monochromaticity_score"), "agbh_monochromaticity_pass", "agbh_monochromaticity_status"
    )


@query("k8_selection_record")
def _(spark, sf):
    scored = calibration.pass_fail(_left_shoulder(spark, sf)).withColumnRenamed("started_on", "started_at")
    record = calibration.selection_record(
        scored, ok="agbh_monochromaticity_pass",
        parameters={"max_score": calibration.MAX_SCORE, "q_min": 2.0, "q_max": 23.0, "beta_ratio": calibration.BETA_RATIO},
    )
    back = spark.read.schema(record.schema).json(storage.write_json(record, storage.new_path(spark, "selection")))
    return back.select("schema_version", "parameters.max_score", "parameters.beta_ratio", "selection.*", F.col("h5_date_filter.op").alias("date_op"))


@query("k8_selection_round_trip")
def _(spark, sf):
    path = calibration.write_selection(_scored_manifest(spark, sf), storage.new_path(spark, "selection"), parameters={"max_score": calibration.MAX_SCORE})
    rows = V.calibration_sets(spark, sf).selectExpr(
        "cast(file_name as string) file_name", "case when session_uid like '%7' then null else 's'||cast(substr(session_uid, 2) as bigint) div 2 end linked_agbh_session_uid",
        "try_to_timestamp(started_at) started_on")
    return calibration.exclude_rejected(rows, path.removesuffix("/record")).select("file_name", "linked_agbh_session_uid")


@query("k9_calibrant_integration")
def _(spark, sf):
    out = signal.profiles_from_bins(_bins(spark, sf, mask=None))
    return out.select(
        "measurement_id", F.size("q_range").alias("points"), r6(P.total(F.col("radial_profile_data")), "profile_sum"),
        r6(F.array_min("q_range"), "q_lo"), r6(F.array_max("q_range"), "q_hi"),
    )


@query("k10_batch_policy")
def _(spark, sf):
    return calibration.batch_policy(_manifest(spark, sf), reference.batch_rules(spark)).select("session_uid", "data_batch", "batch_policy")


@query("k11_reference_band")
def _(spark, sf):
    m = _scored_manifest(spark, sf)
    out = calibration.reference_band(m, F.col("pass") & (F.col("data_batch") == "7"), "score")
    return out.select("session_uid", r6("score"), r6("band_min"), r6("band_median"), r6("band_max"))


# --- J: audits ---------------------------------------------------------------------------------


@query("j1_external_ids")
def _(spark, sf):
    return audits.parse_external_id(V.meta_left(spark, sf).select("measurement_id", "external_id"))


FIELDS = ("age", "thickness", "status")
J = dict(key="external_id", order="measurement_id", fields=FIELDS)


@query("j2_reconciliation")
def _(spark, sf):
    return audits.reconcile(V.meta_left(spark, sf), V.meta_right(spark, sf), **J)


@query("j2_mismatch_rows")
@query("j2_mismatch_fields")
def _(spark, sf):
    """Mismatches of all fields, values as text; numbers with six decimals, compared before that."""
    out = audits.mismatches(V.meta_left(spark, sf), V.meta_right(spark, sf), **J)
    text = lambda c: F.when(F.col("field") == "status", F.col(c)).otherwise(
        X.to_number(c).cast("decimal(18,6)").cast("string")).alias(c)
    return out.select("external_id", "field", text("left_value"), text("right_value"))


@query("j3_backfill")
def _(spark, sf):
    m = V.measurements(spark, sf).select("measurement_id", "sample_thickness_mm")
    fixes = m.selectExpr(
        "measurement_id", "case when measurement_id%3=0 then ' ' else cast(measurement_id%50+20 as string) end new_value"
    )
    out = audits.backfill(m, fixes, key="measurement_id", column="sample_thickness_mm")
    return out.select("measurement_id", "sample_thickness_mm", "sample_thickness_mm_old", "sample_thickness_mm_backfilled")


@query("j3_backfill_summary")
def _(spark, sf):
    m = V.measurements(spark, sf).select("measurement_id", "sample_thickness_mm")
    fixes = m.selectExpr(
        "measurement_id", "case when measurement_id%3=0 then ' ' else cast(measurement_id%50+20 as string) end new_value"
    )
    out = audits.backfill(m, fixes, key="measurement_id", column="sample_thickness_mm")
    return audits.backfill_summary(out, "sample_thickness_mm")
