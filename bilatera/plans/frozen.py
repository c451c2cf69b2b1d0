"""A model with plain fixed parameters, saved and loaded like a trained one.

Queries that apply a model read this one from its path, so their results follow from their input and from numbers that are written here,
not from a fit made elsewhere in the session. Fits have queries of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifact, model, tiers
from ..sources import storage
from .. import schemas as S
from . import views as V

PROFILE_INTERCEPT = 0.1
FINAL_INTERCEPT, PLAIN_INTERCEPT = -0.2, -0.1
#: Imputed value, mean and deviation of the base columns, then mean and deviation of the paired ones, in contract order.
BASE = ((0.5, 0.45, 0.2), (50.0, 55.0, 12.0), (1.0, 0.9, 0.3))
PAIRED = ((0.5, 0.3), (0.1, 0.05), (0.1, 0.05), (0.3, 0.2))
COEF = (1.2, 0.4, -0.3, 0.7, 0.5, -0.6, 0.2)
PLAIN_COEF = (1.0, 0.3, -0.2, 0.0, 0.0, 0.0, 0.0)
THRESHOLD, BORDERLINE, OUTER = 0.45, 0.5, 1.5
RECORD = {"sensitivity": 0.95, "specificity": 0.625}
NAME = {"id": "two_stage_gated_v1", "name": "two_stage_gated", "version": "1", "external_version": "0.6", "internal_version": "0.9"}


def profile_model(points: int = V.VIEW_GRID) -> model.ProfileModel:
    at = range(points)
    return model.ProfileModel(
        tuple(1.0 + (i % 5) / 10 for i in at), tuple(1.0 + (i % 3) / 2 for i in at), tuple((7 * i % 11 - 5) / 40 for i in at), PROFILE_INTERCEPT,
    )


def final_model(coef: tuple[float, ...] = COEF, intercept: float = FINAL_INTERCEPT) -> model.GatedLogisticModel:
    stats = {}
    for c, (fill, mean, std) in zip(S.BASE3, BASE):
        stats |= {f"fill_{c}": fill, f"mean_{c}": mean, f"std_{c}": std}
    for c, (mean, std) in zip(S.CORE4, PAIRED):
        stats |= {f"mean_{c}": mean, f"std_{c}": std}
    return model.GatedLogisticModel(stats, coef, intercept)


def reference_scores(spark: SparkSession, sf: str) -> DataFrame:
    return V.scores(spark, sf).select(F.col("y").alias("label"), F.col("p").alias("p_cancer"))


def saved_model(spark: SparkSession, sf: str) -> artifact.Artifact:
    """The fixed model after a round trip through its path."""
    a = artifact.Artifact(
        profile_model(), final_model(), {"threshold_target": THRESHOLD}, tiers.TierPolicy(THRESHOLD, BORDERLINE, OUTER),
        reference_scores(spark, sf), record=RECORD, name=NAME,
    )
    path = storage.new_path(spark, "model")
    artifact.save(a, path)
    return artifact.load(spark, path)
