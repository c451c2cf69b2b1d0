"""The saved model: both stages, decision rules, reference scores, records and checksums under one path.

``save`` writes five small tables and the reference scores; ``load`` checks the schema version, the table of parts and the digest before anything
is scored. The identity of a model is that digest: SHA-256 over its parameters, thresholds, policy, records, input checksums
and an order-free digest of the reference scores. Reports carry it.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model, tiers

SCHEMA_VERSION = "bilatera_model_v1"
PARTS = "schema_version string, identity string, id string, name string, version string, external_version string, internal_version string, facts string"


@dataclass(frozen=True)
class Artifact:
    """What scoring and reports need. ``reference`` has (label, p_cancer) rows and stays distributed."""

    profile: model.ProfileModel
    final: model.GatedLogisticModel
    thresholds: dict
    policy: tiers.TierPolicy
    reference: DataFrame
    record: dict = field(default_factory=dict)
    held_out: dict = field(default_factory=dict)
    input_sha256: dict = field(default_factory=dict)
    name: dict = field(default_factory=dict)
    identity: str = ""

    def report_identity(self) -> dict:
        """Names and digest as the reports print them."""
        return {**self.name, "sha256": self.identity}


def reference_digest(reference: DataFrame) -> str:
    """Digest of the reference scores as a multiset: counts and sums of row hashes, whatever the order of rows."""
    part = lambda *salt: F.sum(F.xxhash64(*salt, F.col("label").cast("int"), F.col("p_cancer")).cast("decimal(38,0)"))
    row = reference.agg(F.count(F.lit(1)).alias("n"), part(F.lit(1)).alias("a"), part(F.lit(2)).alias("b")).first()
    return f"{row['n']}:{row['a']}:{row['b']}"


def _facts(a: Artifact) -> dict:
    return {
        "thresholds": {k: v for k, v in a.thresholds.items()}, "policy": [a.policy.threshold, a.policy.borderline, a.policy.outer],
        "record": a.record, "held_out": a.held_out, "input_sha256": a.input_sha256,
    }


def digest(a: Artifact) -> str:
    rows = [f"{k}|{i}|{v!r}" for k, i, v in sorted([*a.profile.parameters(), *a.final.parameters()])]
    text = "\n".join([SCHEMA_VERSION, *rows, json.dumps(_facts(a), sort_keys=True, default=str), json.dumps(a.name, sort_keys=True), reference_digest(a.reference)])
    return hashlib.sha256(text.encode()).hexdigest()


def save(a: Artifact, path: str) -> str:
    """Write the model; an existing path is refused. Returns its identity."""
    spark = a.reference.sparkSession
    identity = digest(a)
    a.final.write().save(f"{path}/final")
    model.parameter_table(spark, a.profile).coalesce(1).write.mode("errorifexists").parquet(f"{path}/profile")
    a.reference.select(F.col("label").cast("int").alias("label"), "p_cancer").write.mode("errorifexists").parquet(f"{path}/reference")
    names = [a.name.get(k) for k in ("id", "name", "version", "external_version", "internal_version")]
    row = (SCHEMA_VERSION, identity, *names, json.dumps(_facts(a), sort_keys=True, default=str))
    # Written last: a path without it is an unfinished save.
    spark.createDataFrame([row], PARTS).coalesce(1).write.mode("errorifexists").parquet(f"{path}/parts")
    return identity


def load(spark: SparkSession, path: str) -> Artifact:
    """Read a saved model; another schema version, missing parts or changed content are refused."""
    parts = spark.read.parquet(f"{path}/parts").first()
    if parts is None or parts["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"model schema {parts and parts['schema_version']} is not {SCHEMA_VERSION}")
    facts = json.loads(parts["facts"])
    first = model.load_profile(spark.read.parquet(f"{path}/profile"))
    final = model.GatedLogisticModel.load(f"{path}/final")
    name = {k: parts[k] for k in ("id", "name", "version", "external_version", "internal_version") if parts[k] is not None}
    a = Artifact(
        first, final, facts["thresholds"], tiers.TierPolicy(*facts["policy"]), spark.read.parquet(f"{path}/reference"),
        facts["record"], facts["held_out"], facts["input_sha256"], name, parts["identity"],
    )
    if digest(a) != a.identity:
        raise ValueError("the model's content does not match its identity")
    return a


def from_training(fit: model.Fitted, *, name: dict, record: dict, held_out: dict | None = None, input_sha256: dict | None = None) -> Artifact:
    """An artifact of a training result, not yet saved."""
    held = dict(held_out or {})
    if fit.pooled is not None:  # a row for each metric
        held["pooled"] = {r["metric"]: [r["pooled"], r["ci_low"], r["ci_high"], r["replicates"]] for r in fit.pooled.collect()}
    limits = {k: (float(v) if isinstance(v, float) else v) for k, v in fit.thresholds.items()}
    return Artifact(
        fit.profile, fit.final, limits, fit.policy, fit.scored.select("label", "p_cancer"), dict(record), held, dict(input_sha256 or {}), dict(name),
    )
