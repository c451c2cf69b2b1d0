"""Row, group and session filters, label columns and projections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from .. import schemas as S


@dataclass(frozen=True)
class Predicate:
    """One declarative filter; a disabled one adds nothing to the plan."""

    column: str
    op: str
    value: Any = None
    values: Sequence[Any] = field(default_factory=tuple)
    lower: Any = None
    upper: Any = None
    enabled: bool = True


def predicate(p: Predicate) -> Column:
    """Plain column predicates, so that Parquet pushdown still applies."""
    c = F.col(p.column)
    day = F.to_date(c)
    dates = [F.lit(v).cast("date") for v in p.values] if p.op.startswith("date ") else []
    rules = {
        "==": lambda: c == F.lit(p.value),
        "in": lambda: c.isin(*p.values),
        "not in": lambda: ~c.isin(*p.values),
        ">": lambda: c > F.lit(p.value),
        ">=": lambda: c >= F.lit(p.value),
        "<=": lambda: c <= F.lit(p.value),
        "between": lambda: c.between(p.lower, p.upper),
        "notna": lambda: c.isNotNull(),
        "date>=": lambda: day >= F.lit(p.value).cast("date"),
        "date in": lambda: day.isin(*dates),
        "date not in": lambda: ~day.isin(*dates),
    }
    if p.op not in rules:
        raise ValueError(f"unsupported filter operator: {p.op!r}")
    return rules[p.op]()


def where_all(df: DataFrame, predicates: Iterable[Predicate]) -> DataFrame:
    for p in predicates:
        if p.enabled:
            df = df.where(predicate(p))
    return df


def exclude_sessions(
    df: DataFrame,
    ids: Sequence[str] | DataFrame,
    dates: Sequence[str] | DataFrame,
    *,
    id_column: str = "linked_agbh_session_uid",
    date_column: str = "started_on",
) -> DataFrame:
    """Drop rows whose linked id is listed; only rows without an id fall back to listed dates.

    Literal lists become an ``IN`` set inside the scan stage. Lists given as one-column DataFrames may
    be of any size and become anti joins on the two disjoint halves, where Spark picks the join from
    the measured sizes.
    """
    day = F.to_date(date_column)
    if isinstance(ids, DataFrame) and isinstance(dates, DataFrame):
        id_list = ids.toDF(id_column).distinct()
        day_list = dates.select(F.col(dates.columns[0]).cast("date").alias("_day")).distinct()
        linked = df.where(F.col(id_column).isNotNull()).join(id_list, id_column, "left_anti")
        loose = df.where(F.col(id_column).isNull()).withColumn("_day", day)
        loose = loose.join(day_list, "_day", "left_anti").drop("_day")
        return linked.unionByName(loose)
    by_date = F.lit(True) if not dates else F.coalesce(~day.isin(*[F.lit(d).cast("date") for d in dates]), F.lit(True))
    by_id = F.lit(True) if not ids else ~F.col(id_column).isin(*ids)
    return df.where(F.when(F.col(id_column).isNull(), by_date).otherwise(by_id))


def keep_groups_with(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Every row of a group that has at least one matching row.

    The right side holds one row per qualifying key; a hot key stays splittable on the left.
    """
    keys = df.where(condition).select(key).distinct()
    return df.join(keys, key, "left_semi")


def label_columns(
    df: DataFrame,
    *,
    normal_as_benign: bool = True,
    cancer_values: Sequence[str] = S.CANCER_VALUES,
    benign_values: Sequence[str] = ("BENIGN",),
    with_patient: bool = True,
) -> DataFrame:
    """Product label per row (one label per specimen), and per patient: CANCER if any specimen is.

    NORMAL joins BENIGN in the training route and stays NORMAL otherwise; anything else is null.
    """
    status = F.col("specimen_status")
    benign = (*benign_values, "NORMAL") if normal_as_benign else tuple(benign_values)
    group = F.when(status.isin(*cancer_values), "CANCER").when(status.isin(*benign), "BENIGN")
    if not normal_as_benign:
        group = group.when(status == "NORMAL", "NORMAL")
    out = df.withColumn("product_status_group", group).withColumn("product_diagnosis", group)
    if not with_patient:
        return out
    rank = F.when(group == "CANCER", 3).when(group == "BENIGN", 2).when(group == "NORMAL", 1)
    patients = df.groupBy("patientId").agg(F.max(rank).alias("_rank"))
    patients = patients.select(
        "patientId",
        F.when(F.col("_rank") == 3, "CANCER").when(F.col("_rank") == 2, "BENIGN")
        .when(F.col("_rank") == 1, "NORMAL").alias("patient_product_diagnosis"),
    )
    return out.join(patients, "patientId", "left")


def label_filter_stats(df: DataFrame, allowed: Sequence[str] = S.GROUP_KEEP) -> DataFrame:
    """Rows in, kept and dropped by the mapped-label filter."""
    ok = F.coalesce(F.col("product_status_group").isin(*allowed), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(ok).alias("rows_kept"), F.count_if(~ok).alias("rows_dropped")
    )


def keep_label_pairs(df: DataFrame, allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """Patients whose two sides carry an allowed, unordered pair of labels.

    Per patient the set holds at most the handful of label values, so it stays small for any row count.
    """
    sides = df.where(F.col("product_status_group").isNotNull()).select(
        "patientId", X.side_norm("side").alias("side_norm"), "product_status_group"
    )
    pairs = (
        sides.where("side_norm is not null")
        .groupBy("patientId", "side_norm").agg(F.max("product_status_group").alias("label"))
        .groupBy("patientId")
        .agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    )
    ok = F.lit(False)
    for a, b in allowed:
        lo, hi = sorted((a, b))
        ok = ok | ((F.col("lo") == lo) & (F.col("hi") == hi))
    return df.join(pairs.where((F.col("n") == 2) & ok).select("patientId"), "patientId", "left_semi")


def specimen_validity(df: DataFrame, *, min_measurements: int = 1, min_specimens: int = 1) -> DataFrame:
    """Add the measurement count of each specimen and drop thin specimens, then thin patients.

    Counts come from partial aggregation and are joined back, so a specimen of any size is never
    gathered into one window partition.
    """
    counts = df.groupBy("patientId", "specimenId").agg(F.count(F.lit(1)).alias("specimen_measurement_count"))
    good = counts.where(F.col("specimen_measurement_count") >= min_measurements)
    patients = good.groupBy("patientId").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_specimens)
    good = good.join(patients.select("patientId"), "patientId", "left_semi")
    return df.join(good, ["patientId", "specimenId"])


def stage1_rows(df: DataFrame, policy: str = "biopsy_only") -> DataFrame:
    """Labelled measurement rows admitted to the first stage."""
    out = df.where(F.col("product_status_group").isin(*S.GROUP_KEEP))
    if policy == "biopsy_only":
        return out.where(X.as_flag("biopsy"))
    if policy != "all_rows":
        raise ValueError(f"unsupported row policy: {policy!r}")
    return out


def stage1_guard(rows: DataFrame) -> DataFrame:
    """One row: counts, and whether both classes are present."""
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("patientId").alias("patients"),
        F.count_if(F.col("product_status_group") == "BENIGN").alias("benign_rows"),
        F.count_if(F.col("product_status_group") == "CANCER").alias("cancer_rows"),
    ).withColumn("two_classes", (F.col("benign_rows") > 0) & (F.col("cancer_rows") > 0))


def require_two_classes(rows: DataFrame) -> DataFrame:
    """Fail with the counts when a class is missing."""
    g = stage1_guard(rows).first()
    if not g["two_classes"]:
        raise ValueError(f"both classes are required: {g.asDict()}")
    return rows


def keep_columns(df: DataFrame, columns: Sequence[str], errors: str = "raise") -> DataFrame:
    """Contract columns in order; a missing one raises or is ignored."""
    if len(set(columns)) != len(columns):
        raise ValueError("output columns must be unique")
    missing = [c for c in columns if c not in df.columns]
    if missing and errors == "raise":
        raise KeyError(f"missing columns: {missing}")
    return df.select(*[c for c in columns if c in df.columns])


def container_violations(
    df: DataFrame, *, schema_version: str, fmt: str, expected: str = "expected_patient_id"
) -> DataFrame:
    """One row per container that breaks the one-patient contract, with the first reason.

    Patient id falls back from the set attribute to the sample's patient name. Only min, max and
    counts are kept per container, never the id list.
    """
    pid = F.coalesce(X.non_blank("set_patient_id"), X.non_blank("sample_patient_name"))
    agg = df.withColumn("_pid", pid).groupBy("container_id").agg(
        F.min("_pid").alias("lo"), F.max("_pid").alias("hi"), F.max(expected).alias("want"),
        F.min(F.col("schema_version").eqNullSafe(F.lit(schema_version))).alias("version_ok"),
        F.min(F.col("format").eqNullSafe(F.lit(fmt))).alias("format_ok"),
    )
    reason = (
        F.when(~F.col("version_ok"), "schema_version")
        .when(~F.col("format_ok"), "format")
        .when(F.col("lo").isNull(), "no_patient")
        .when(F.col("lo") != F.col("hi"), "several_patients")
        .when(F.col("lo") != F.col("want"), "other_patient")
    )
    return agg.select("container_id", reason.alias("reason")).where("reason is not null")


def consensus(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per group keep a value only when all non-blank values agree (min equals max)."""
    aggs = []
    for c in columns:
        v = X.non_blank(c)
        aggs.append(F.when(F.min(v) == F.max(v), F.min(v)).alias(c))
    return df.groupBy(*keys).agg(*aggs)
