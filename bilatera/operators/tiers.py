"""Threshold-centred decision and risk tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import ordered

# Fixed values of the tier policy.
MIN_UNSTABLE, DEFAULT_MARGIN, STEP = 5, 0.5, 0.1
MARGIN_RANGE = (0.1, 2.0)
OUTER = 3.0


@dataclass(frozen=True)
class TierPolicy:
    """Decision threshold and logit margins; lower < 0 < upper < high must hold."""

    threshold: float
    borderline: float
    outer: float

    def check(self) -> TierPolicy:
        if not 0.0 < self.threshold < 1.0:
            raise ValueError("decision threshold must lie strictly between 0 and 1")
        if not 0.0 < self.borderline < self.outer:
            raise ValueError("tier boundaries must increase around the threshold")
        return self


def decision(p: Column | str, threshold: Column) -> Column:
    """High risk, review needed, at or above the threshold."""
    return X.col(p) >= threshold


def risk_level(p: Column | str, threshold: Column) -> Column:
    return F.when(decision(p, threshold), "high").otherwise("low")


def stability(oof: DataFrame, threshold: Column) -> DataFrame:
    """Per case: median held-out score, share of the majority decision, logit margin to the threshold.

    A case has one row per repeat, so the median buffer is small.
    """
    share = F.avg("y_pred_target")
    out = oof.groupBy("target_case_id").agg(
        F.median("p_cancer").alias("p_cancer"), F.greatest(share, F.lit(1.0) - share).alias("decision_stability")
    )
    return out.withColumn("margin", X.logit("p_cancer") - X.logit(threshold))


def round_margin(value: Column) -> Column:
    """Half-even rounding to 0.1, then clipping."""
    rounded = F.bround(value / STEP) * F.lit(STEP)
    return F.bround(X.clip(rounded, *MARGIN_RANGE), 1)


def tier_margins(cases: DataFrame) -> DataFrame:
    """One row: case counts, borderline and outer margin, and whether the held-out rule applied."""
    unstable = cases.where(F.col("decision_stability") < 1.0).select(F.abs("margin").alias("m"))
    middle = ordered.quantiles(unstable, "m", {"m": 0.5})
    total = cases.agg(
        F.count(F.lit(1)).alias("target_cases"),
        F.count_if(F.col("decision_stability") < 1.0).alias("unstable_target_cases"),
    )
    # Both sides hold exactly one row.
    out = total.join(F.broadcast(middle))
    used = F.col("unstable_target_cases") >= MIN_UNSTABLE
    border = F.when(used, round_margin(F.col("m"))).otherwise(F.lit(DEFAULT_MARGIN))
    out = out.withColumns({"calibrated": used, "borderline_margin": border}).drop("m")
    return out.withColumn("outer_margin", round_margin(F.col("borderline_margin") * OUTER))


def tier(p: Column | str, threshold: Column, borderline: Column, outer: Column) -> Column:
    """Tier 1..5 by logit margin; tier 2/3 meet at the threshold."""
    m = X.logit(p) - X.logit(threshold)
    return (
        F.when(m < -borderline, 1).when(m < 0, 2).when(m < borderline, 3).when(m < outer, 4).otherwise(5).cast("int")
    )


def fit_policy(oof: DataFrame | None, threshold: float) -> TierPolicy:
    """Freeze the policy; without held-out predictions the default margins are used."""
    if oof is None:
        return TierPolicy(threshold, DEFAULT_MARGIN, OUTER * DEFAULT_MARGIN).check()
    row = tier_margins(stability(oof, F.lit(float(threshold)))).first()
    return TierPolicy(threshold, row["borderline_margin"], row["outer_margin"]).check()
