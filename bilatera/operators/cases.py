"""Target cases, roll-ups per case and patient, reliability, cohort summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from .. import schemas as S
from .filters import stage1_rows


def paired_sides(df: DataFrame) -> DataFrame:
    """One row per (patient, normalised side): rows, biopsied label range, and the opposite side if any.

    Both sides of a patient come out of one partial aggregate, so pairing needs no self join and a
    patient with very many rows is reduced in every task before the shuffle.
    """
    hit = F.col("product_status_group").isin(*S.GROUP_KEEP) & X.as_flag("biopsy")
    label = F.when(hit, X.binary_label("product_status_group"))
    rows = df.select("patientId", X.side_norm("side").alias("_s"), label.alias("_l")).where("_s is not null")
    aggs = []
    for s in ("LEFT", "RIGHT"):
        mine = F.col("_s") == s
        aggs += [
            F.count_if(mine).alias(f"n_{s}"), F.min(F.when(mine, F.col("_l"))).alias(f"lo_{s}"),
            F.max(F.when(mine, F.col("_l"))).alias(f"hi_{s}"),
        ]
    one = "named_struct('side_norm','{a}','side_rows',n_{a},'label_min',lo_{a},'label_max',hi_{a},"
    one += "'contralateral_side_norm',if(n_{b}>0,'{b}',null),'contralateral_rows',if(n_{b}>0,n_{b},null))"
    both = ",".join(one.format(a=a, b=b) for a, b in (("LEFT", "RIGHT"), ("RIGHT", "LEFT")))
    return rows.groupBy("patientId").agg(*aggs).selectExpr("patientId", f"inline(array({both}))").where("side_rows > 0")


def case_id(patient: Column, side: Column) -> Column:
    return F.concat_ws("::", patient, side)


def target_cases(df: DataFrame, *, ambiguous: str = "fail") -> DataFrame:
    """One case per biopsied (patient, side). Two labels on one side fail the job, or with ``largest`` count as positive."""
    if ambiguous not in ("fail", "largest"):
        raise ValueError(f"ambiguous must be 'fail' or 'largest', not {ambiguous!r}")
    message = F.concat(F.lit("ambiguous labels for "), case_id(F.col("patientId"), F.col("side_norm")))
    label = F.col("label_max")
    if ambiguous == "fail":
        label = F.when(F.col("label_min") == label, label).otherwise(F.raise_error(message).cast("int"))
    return (
        paired_sides(df)
        .where("label_max is not null")
        .select(
            case_id(F.col("patientId"), F.col("side_norm")).alias("target_case_id"),
            "patientId",
            F.col("side_norm").alias("target_side_norm"),
            X.side_display("side_norm").alias("target_side"),
            "contralateral_side_norm",
            X.side_display("contralateral_side_norm").alias("contralateral_side"),
            label.alias("label"),
        )
    )


def logit_average(p: Column) -> Column:
    """Aggregate: sigmoid of the mean clipped logit; 0.5 for an empty group."""
    return F.coalesce(X.expit(F.avg(X.logit(p))), F.lit(0.5))


def case_scores(cases: DataFrame, row_scores: DataFrame) -> DataFrame:
    """Mean probability, logit average and row count of the target side per case.

    ``row_scores`` has patientId, side, p. Scores are reduced per (patient, side) before the join.
    A case without any score fails the job.
    """
    per_side = (
        row_scores.select("patientId", X.side_norm("side").alias("target_side_norm"), "p")
        .groupBy("patientId", "target_side_norm")
        .agg(
            F.avg("p").alias("profile_p_cancer_probability_mean"),
            logit_average(F.col("p")).alias("profile_p_cancer_logit_average"),
            F.count("p").alias("profile_p_cancer_n_measurements"),
        )
    )
    n = F.col("profile_p_cancer_n_measurements")
    missing = F.raise_error(F.concat(F.lit("no scores for "), F.col("target_case_id"))).cast("long")
    return cases.select("target_case_id", "patientId", "target_side_norm").join(
        per_side, ["patientId", "target_side_norm"], "left"
    ).select(
        "target_case_id", "profile_p_cancer_probability_mean", "profile_p_cancer_logit_average",
        F.when(n.isNull(), missing).otherwise(n).alias("profile_p_cancer_n_measurements"),
    )


def patient_rollup(df: DataFrame) -> DataFrame:
    """Distinct specimens, rows, median age (0 when absent) and age flag per patient.

    The median buffer holds one counter per distinct age, however many rows a patient has.
    """
    age = X.to_number("age")
    rows = df.groupBy("patientId").agg(
        F.count(F.lit(1)).alias("measurements"),
        F.coalesce(F.median(age), F.lit(0.0)).alias("age"),
        F.max(age.isNotNull()).cast("int").alias("age_available"),
    )
    specimens = (
        df.select("patientId", "specimenId").distinct()
        .groupBy("patientId").agg(F.count("specimenId").alias("specimens"))
    )
    return rows.join(specimens, "patientId").select(
        "patientId", "specimens", "measurements", "age", "age_available"
    )


def reliability(df: DataFrame) -> DataFrame:
    """Measurement sufficiency flags and the ordered reliability level and reason."""
    t, c = F.col("target_measurements"), F.col("contralateral_measurements")
    low = F.least(t, c)
    paired = (F.col("symmetry_available") == 1) & (low >= 2)
    level = F.when(paired, "high").when(t >= 2, "medium").otherwise("low")
    reason = (
        F.when(paired, "at least 2 valid measurements per breast; symmetry refinement applied")
        .when(
            F.coalesce(F.col("symmetry_reason"), F.lit("")) == "sk_core4_not_computable",
            "symmetry features could not be computed; symmetry refinement not applied",
        )
        .when(c == 0, "contralateral breast unavailable after preprocessing; symmetry refinement not applied")
        .when(
            t >= 2, "fewer than 2 valid contralateral-breast measurements; symmetry refinement not applied"
        )
        .otherwise("fewer than 2 valid target-breast measurements")
    )
    flag = lambda x: x.cast("int")
    return df.withColumns(
        {
            "min_measurements_per_breast": low,
            "target_measurements_ok": flag(t >= 2),
            "contralateral_measurements_ok": flag(c >= 2),
            "paired_measurements_ok": flag(paired),
            "high_reliability_measurements_ok": flag(paired),
            "profile_measurements_ok": flag(F.col("profile_p_cancer_n_measurements") >= 2),
            "result_reliability": level,
            "result_reliability_reason": reason,
        }
    )


def feature_table(cases: DataFrame, patients: DataFrame, pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Final-model input: cases with patient roll-up, paired features and case scores."""
    out = (
        cases.join(patients, "patientId")
        .join(pairs, "target_case_id")
        .join(scores, "target_case_id")
        .withColumn("label_name", X.label_name("label"))
    )
    return reliability(out)


def cohort_summary(df: DataFrame) -> DataFrame:
    """Rows per label, overall and among biopsied rows; null label shown as <missing>."""
    return df.groupBy(F.coalesce("product_status_group", F.lit("<missing>")).alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(X.as_flag("biopsy")).alias("biopsy_rows")
    )


def cohort_totals(df: DataFrame) -> DataFrame:
    """Rows and patients of the cohort."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("patientId").alias("patients"))


def dataset_summary(df: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: measurements, patients, specimens, first-stage rows and patients, cases by class."""
    rows = df.agg(
        F.count(F.lit(1)).alias("measurements"),
        F.count_distinct("patientId").alias("patients"),
        F.count_distinct("specimenId").alias("specimens"),
    )
    admitted = stage1_rows(df).agg(
        F.count(F.lit(1)).alias("lr1_measurements"), F.count_distinct("patientId").alias("lr1_patients")
    )
    final = cases.agg(
        F.count_distinct("patientId").alias("final_patients"),
        F.count(F.lit(1)).alias("final_target_cases"),
        F.count_if(F.col("label") == 1).alias("final_cancer_target_cases"),
        F.count_if(F.col("label") == 0).alias("final_benign_target_cases"),
    )
    key = lambda d: d.withColumn("_one", F.lit(1))
    return key(rows).join(key(admitted), "_one").join(key(final), "_one").drop("_one")


def availability_warnings(features: DataFrame) -> DataFrame:
    """Counts of cases without pairing or with fewer than two measurements on a side."""
    return features.agg(
        F.count_if(F.col("symmetry_available") == 0).alias("unpaired_cases"),
        F.count_if(F.col("target_measurements") < 2).alias("low_target_cases"),
        F.count_if(F.col("contralateral_measurements") < 2).alias("low_contralateral_cases"),
    )


def roll_labels(cases: DataFrame, keys: Sequence[str] = ("patientId",)) -> DataFrame:
    """Split-unit label: the maximum over a patient's cases."""
    return cases.groupBy(*keys).agg(F.max("label").alias("label"))
