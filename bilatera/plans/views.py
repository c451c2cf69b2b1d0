"""Deterministic views that give the driver tables the shapes of the data model.

Every view is plain IEEE arithmetic over whole tables; the SQL twins live in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import cases, filters, signal
from ..operators.filters import Predicate

# Limits used on the views: the product gate of 2.0 leaves no row, the product band holds one point.
VIEW_BAND = (6.6, 7.4)
VIEW_GATE = 0.8
VIEW_GRID = 64
EXCLUDED_IDS = ("cal_1", "cal_5", "cal_9")
EXCLUDED_DAYS = ("2025-02-14", "2025-03-04")
# Patient ids have four digits, so patients from 10,000 on share the ids of earlier ones, and a side can hold two labels.
AMBIGUOUS = "largest"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "embeddings").selectExpr(
        "vec_id m", "vec_id div 6 p", "vec_id div 3 sp", "embedding"
    )
    return b.selectExpr(
        "m measurement_id",
        "'P'||lpad(cast(p as string),4,'0') patientId",
        "'P'||lpad(cast(p as string),4,'0')||case when m%6<3 then '_Left' else '_Right' end specimenId",
        "case when m%6<3 then 'Left' else 'Right' end side",
        "case when m%17=16 then 'P4_R' else 'P'||cast(m%3+1 as string) end position",
        "case sp*5%7 when 0 then 'BENIGN' when 1 then 'NORMAL' when 2 then 'CANCER' when 3 then 'ATYPICAL' "
        "when 4 then 'PRE_CANCEROUS' when 5 then 'BENIGN' else 'NA' end specimen_status",
        "(p%11<>10) and (m%6<3 or p%5=0) biopsy",
        "case when p%13=12 then null else cast(35+p%40 as double) end age",
        "case when m%29=28 then null else cast(40+m%31 as double) end sample_thickness_mm",
        "case when m%37=36 then 5e1 when p<40 then 4e1 else 1e1 end calibrant_thickness_mm",
        "case when m%41=40 then 2e1 else 25e0 end poni_q_max_nm_inv",
        "date_add(date '2025-02-06', cast(p as int)) started_on",
        "case when p%9=8 then null else 'cal_'||cast(p div 4 as string) end linked_agbh_session_uid",
        "transform(sequence(0,63), i -> 2e0+cast(i as double)/3e0) q_range",
        "transform(embedding, x -> 3e0+4e0*cast(x as double)) radial_profile_data",
    )


def quality_rules() -> list[Predicate]:
    return [
        Predicate("position", "in", values=("P1", "P2", "P3")),
        Predicate("sample_thickness_mm", "notna"),
        Predicate("sample_thickness_mm", ">", value=0.0),
        Predicate("calibrant_thickness_mm", "between", lower=2.0, upper=40.0),
        Predicate("poni_q_max_nm_inv", ">=", value=23.0),
    ]


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    """Training route up to the label filter."""
    df = filters.where_all(measurements(spark, sf), quality_rules())
    df = filters.exclude_sessions(df, EXCLUDED_IDS, EXCLUDED_DAYS)
    df = filters.label_columns(df, with_patient=False)
    df = filters.keep_groups_with(df, "patientId", df["biopsy"])
    return filters.where_all(df, [Predicate("product_status_group", "in", values=("BENIGN", "CANCER"))])


def normalised(spark: SparkSession, sf: str) -> DataFrame:
    return signal.band_normalise(cohort(spark, sf), *VIEW_BAND)


def gated(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that reach feature building."""
    return signal.profile_gate(normalised(spark, sf), threshold=VIEW_GATE).where("radial_profile_value_pass")


def target_cases(rows: DataFrame) -> DataFrame:
    """Cases of rows of the views."""
    return cases.target_cases(rows, ambiguous=AMBIGUOUS)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey case_id", "o_custkey patient", "cast(o_orderstatus='F' as int) y",
        "least(greatest(o_totalprice/6e5,1e-6),1e0-1e-6) p",
    )


def scores_tied(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "cast(l_returnflag='R' as int) y", "(l_discount*1e2+1e0)/12e0 p"
    )


def oof(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out predictions of every order over five splits, with a per-split threshold."""
    base = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "explode(sequence(0, 4)) split_id"
    )
    base = base.selectExpr(
        "'C'||cast(o_orderkey as string) target_case_id",
        "'K'||cast(o_custkey as string) patientId",
        "cast(o_orderstatus='F' as int) label",
        "cast(split_id as int) split_id",
        "least(greatest(o_totalprice/6e5 + cast((o_orderkey*7+split_id*13)%21-10 as double)/1e2, 1e-6), 1e0-1e-6)"
        " p_cancer",
        "25e-2 + cast(split_id as double)/1e2 threshold_target",
    )
    return base.selectExpr("*", "cast(p_cancer >= threshold_target as int) y_pred_target")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey measurement_id", "cast(l_linenumber as int) row", "cast(l_suppkey as int) col",
        "2e0+21e0*cast(l_partkey%997 as double)/997e0 q", "l_quantity counts", "l_extendedprice/1e2 bright",
        "cast(l_partkey%997 as double)/997e0/2e0 radius",
    )


def calibration_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration set rows with JSON provenance, one per event."""
    return table(spark, sf, "events").selectExpr(
        "'/cal/'||cast(event_id as string)||'.h5' file_path",
        "cast(event_id as string)||'.h5' file_name",
        "'s'||cast(event_id as string) session_uid",
        "case when event_id%53=52 then 'n/a' else substr(cast(ts as string),1,19) end started_at",
        "'set_'||cast(user_id%3 as string) set_name",
        "case event_type when 'view' then 'Silver Behenate 1' when 'click' then 'silver behenate QC' "
        "else event_type end measurement_type_name",
        "case when event_type in ('view','click') then 'CALIBRATION' else 'SAMPLE' end measurement_type_category",
        "'{\"backfill_provenance\":{'||case when user_id%8=7 then '' else "
        "'\"data_batch\":\"'||cast(user_id%8 as string)||'\",' end||'\"source_line\":\"'||"
        "case when user_id%8 in (1,2,6) then 'k-beta' else 'k-alpha' end||'\",\"nova_range\":\"'||"
        "cast(user_id as string)||'\"},\"props\":'||props||'}' metadata",
        "case when event_id%31=30 then cast(null as double) else value*2e0 end distance",
        "cast(event_id%5+1 as double) exposure_time",
        "case when event_id%7<>6 then 'poni' end poni",
        "case when event_id%11<>10 then 'raw' end raw_file",
    )


def calibration_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrant profiles; the label column becomes the batch."""
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id", "'s'||cast(vec_id as string) session_uid", "cast(label%7+1 as string) data_batch",
        "date_add(date '2025-02-06', cast(vec_id div 6 as int)) started_on",
        "cast(vec_id as string)||'.h5' file_name",
        "transform(sequence(0,63), i -> 2e0+cast(i as double)/3e0) q_range",
        "transform(embedding, x -> 3e0+4e0*cast(x as double)) radial_profile_data",
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One scoring request per patient, sides alternating."""
    return measurements(spark, sf).select("patientId").distinct().selectExpr(
        "patientId",
        "case when cast(substr(patientId,2) as bigint)%2=0 then 'left' else 'right' end target_side",
        "'author' analysis_author", "'' prediction_comment",
    )


def meta_left(spark: SparkSession, sf: str) -> DataFrame:
    return measurements(spark, sf).selectExpr(
        "measurement_id", "patientId||'_'||upper(side)||'_'||position external_id",
        "age", "sample_thickness_mm thickness", "specimen_status status",
    )


def meta_right(spark: SparkSession, sf: str) -> DataFrame:
    return measurements(spark, sf).where("measurement_id%10<>0").selectExpr(
        "measurement_id", "patientId||'_'||upper(side)||'_'||position external_id",
        "case when measurement_id%7=0 then age+1e0 else age end age", "sample_thickness_mm thickness",
        "specimen_status status",
    )
