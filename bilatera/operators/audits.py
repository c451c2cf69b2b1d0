"""Metadata audits: external ids, reconciliation of two tables, null back-fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X

ID_PATTERN = r"^(.+)_(LEFT|RIGHT)_(P\w+)$"


def parse_external_id(df: DataFrame, column: str = "external_id", pattern: str = ID_PATTERN) -> DataFrame:
    """Patient, side and point of an external id; null parts where the text does not fit."""
    part = lambda i: F.nullif(F.regexp_extract(F.col(column), pattern, i), F.lit(""))
    return df.withColumns({"ext_patient": part(1), "ext_side": part(2), "ext_position": part(3)})


def first_per_key(df: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """One row per key (smallest ``order``) with its row count; partial aggregation, no sort per key."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(order, *fields)).alias("_r")
    ).select(key, "n", *[F.col(f"_r.{f}").alias(f) for f in fields])


def _paired(left: DataFrame, right: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    tag = lambda d, t: first_per_key(d, key, order, fields).select(
        key, F.col("n").alias(f"n_{t}"), *[F.col(f).cast("string").alias(f"{f}_{t}") for f in fields]
    )
    return tag(left, "l").join(tag(right, "r"), key, "full_outer")


def reconcile(left: DataFrame, right: DataFrame, *, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """One row: rows, unique, duplicate, matched, left-only and right-only keys, mismatching fields and keys."""
    both = _paired(left, right, key, order, fields)
    matched = F.col("n_l").isNotNull() & F.col("n_r").isNotNull()
    diffs = [(~F.col(f"{f}_l").eqNullSafe(F.col(f"{f}_r"))).cast("int") for f in fields]
    wrong = F.when(matched, sum(diffs[1:], diffs[0])).otherwise(F.lit(0))
    return both.agg(
        F.sum(F.coalesce("n_l", F.lit(0))).alias("left_rows"), F.sum(F.coalesce("n_r", F.lit(0))).alias("right_rows"),
        F.count("n_l").alias("left_keys"), F.count("n_r").alias("right_keys"),
        F.count_if(F.col("n_l") > 1).alias("left_duplicate_keys"),
        F.count_if(F.col("n_r") > 1).alias("right_duplicate_keys"),
        F.count_if(matched).alias("matched_keys"),
        F.count_if(F.col("n_r").isNull()).alias("left_only_keys"),
        F.count_if(F.col("n_l").isNull()).alias("right_only_keys"),
        F.sum(wrong).alias("mismatch_rows"), F.count_if(wrong > 0).alias("mismatched_keys"),
    )


def mismatches(left: DataFrame, right: DataFrame, *, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, left_value, right_value) for matched keys whose values differ, nulls compared as values."""
    both = _paired(left, right, key, order, fields).where("n_l is not null and n_r is not null")
    cells = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f"{f}_l").alias("left_value"), F.col(f"{f}_r").alias("right_value"))
          for f in fields]
    )
    return both.select(key, F.inline(cells)).where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def backfill(df: DataFrame, corrections: DataFrame, *, key: str, column: str) -> DataFrame:
    """Fill nulls from (key, new_value) where the new value is a number; adds old value and a flag."""
    fix = corrections.select(key, X.to_number("new_value").alias("_new")).groupBy(key).agg(F.max("_new").alias("_new"))
    old = F.col(column)
    return df.join(fix, key, "left").withColumns(
        {
            f"{column}_old": old,
            f"{column}_backfilled": old.isNull() & F.col("_new").isNotNull(),
            column: F.coalesce(old, F.col("_new")),
        }
    ).drop("_new")


def backfill_summary(filled: DataFrame, column: str) -> DataFrame:
    return filled.agg(
        F.count_if(F.col(f"{column}_old").isNull()).alias("missing_before"),
        F.count_if(f"{column}_backfilled").alias("backfilled_rows"),
        F.count_if(F.col(column).isNull()).alias("missing_after"),
    )
