"""Patient-safe repeated stratified folds and patient-cluster bootstrap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.storage import cut_lineage
from . import metrics, ordered
from . import replicates as R


def assign_folds(cases: DataFrame, *, folds: int = 5, repeats: int = 20, seed: int = 42) -> DataFrame:
    """(repeat, patientId, label, fold): stratified by the patient's maximum label.

    Per repeat, patients are ordered by (label, md5 of seed, repeat and patient) and dealt out modulo the
    fold count, so class counts differ by at most one. The order comes from one range shuffle, not from one sort per repeat.
    """
    patients = cases.groupBy("patientId").agg(F.max("label").alias("label"))
    deck = patients.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    deck = deck.withColumn(
        "_h", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("repeat").cast("string"), "patientId"))
    )
    ranked = ordered.dense_index(deck, ["label", "_h", "patientId"], ["repeat"], "_ix")
    return ranked.select("repeat", "patientId", "label", (F.col("_ix") % folds).cast("int").alias("fold"))


def split_members(assigned: DataFrame, *, folds: int = 5) -> DataFrame:
    """(split_id, patientId, role): split = repeat * folds + fold; the own fold is the test part."""
    return assigned.select(
        (F.col("repeat") * folds + F.col("fold")).alias("_own"), F.col("repeat"), "patientId",
        F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("_f"),
    ).select(
        (F.col("repeat") * folds + F.col("_f")).alias("split_id"), "patientId",
        F.when(F.col("_own") == F.col("repeat") * folds + F.col("_f"), "test").otherwise("train").alias("role"),
    )


def split_rows(df: DataFrame, members: DataFrame, role: str) -> DataFrame:
    """Rows of one role, one copy per split: a join of rows with (split_id, patientId) membership."""
    return df.join(members.where(F.col("role") == role).select("split_id", "patientId"), "patientId")


def split_sums(df: DataFrame, assigned: DataFrame, sums: dict[str, Column], *, folds: int = 5, role: str = "test") -> DataFrame:
    """(split_id, sums) over the rows of one role in every split, without a row for each split.

    Rows are first added up by patient. A patient's folds are one array, and a task adds a patient's sums to the split that holds it out
    in every repeat; sums of the training part are those of all patients less these. Tasks give splits x sums numbers.
    """
    names = list(sums)
    per = df.groupBy("patientId").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    listed = F.array_sort(F.collect_list(F.struct("repeat", "fold")))
    held = assigned.groupBy("patientId").agg(F.transform(listed, lambda s: s["fold"]).alias("_folds"))
    kinds = {n: per.schema[n].dataType.simpleString() for n in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for b in batches:
            if not b.num_rows:
                continue
            values = [b.column(n).fill_null(0).to_numpy(zero_copy_only=False) for n in names]
            fold = b.column("_folds").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            repeats = fold.shape[1]
            acc = acc or [np.zeros((repeats, folds), v.dtype) for v in values]
            for total, v in zip(acc, values):
                if role == "test":
                    np.add.at(total, (np.broadcast_to(np.arange(repeats), fold.shape), fold), v[:, None])
                else:
                    total += v.sum()
                    np.subtract.at(total, (np.broadcast_to(np.arange(repeats), fold.shape), fold), v[:, None])
        if acc:
            cells = [np.arange(acc[0].size, dtype=np.int32), *[a.ravel() for a in acc]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["split_id", *names])

    rows = per.join(held, "patientId").select("_folds", *names)
    out = rows.mapInArrow(run, "split_id int, " + ", ".join(f"{n} {k}" for n, k in kinds.items()))
    return out.groupBy("split_id").agg(*[F.sum(n).alias(n) for n in names])


def leakage(members: DataFrame) -> DataFrame:
    """(split_id, patientId) pairs present in both roles; must be empty."""
    pick = lambda r: members.where(F.col("role") == r).select("split_id", "patientId")
    return pick("train").intersect(pick("test"))


def bootstrap_weights(patients: DataFrame, *, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(b, patientId, w): how often each patient was drawn in each replicate, w >= 1.

    A replicate draws as many patients as there are, with replacement. Every patient row supplies one draw
    slot per replicate, so draws are generated in parallel and never counted on the driver.
    """
    known = R.indexed(patients)
    total = known.agg(F.count(F.lit(1)).alias("_n"))
    # ``total`` is exactly one row.
    slots = known.select("ix").join(F.broadcast(total)).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    )
    drawn = slots.select("b", R.draw(seed, F.col("b"), F.col("ix"), F.col("_n")).alias("ix"))
    counts = drawn.groupBy("b", "ix").agg(F.count(F.lit(1)).alias("w"))
    return counts.join(known, "ix").select("b", "patientId", "w")


def bootstrap_cases(cases: DataFrame, weights: DataFrame) -> DataFrame:
    """Cases of every replicate with their multiplicity; repeated draws are kept as a weight."""
    return cases.join(weights, "patientId")


BOOT_METRICS = (
    "roc_auc", "pr_auc", "sensitivity", "specificity", "balanced_accuracy", "ppv", "npv", "brier_score", "log_loss",
)


CELLS = ("tp", "tn", "fp", "fn", "square", "loss")


def packed_cases(cases: DataFrame, *, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Cases with the draws of their patient in every replicate, one row each; see ``replicates``."""
    counts = R.packed_counts(cases, replicates=replicates, seed=seed)
    rows = cases.select("patientId", F.col("label").alias("y"), F.col("p_cancer").alias("p"), "threshold_target")
    return cut_lineage(rows.join(cut_lineage(counts), "patientId"))


def bootstrap_metrics(cases: DataFrame, *, replicates: int = 2000, seed: int = 42, block: int = R.BLOCK) -> DataFrame:
    """Closed-form metrics of every two-class replicate; needs patientId, label, p_cancer, threshold_target."""
    return replicate_metrics(packed_cases(cases, replicates=replicates, seed=seed), replicates, block)


def replicate_metrics(rows: DataFrame, replicates: int, block: int = R.BLOCK) -> DataFrame:
    """Metrics of every two-class replicate of ``packed_cases``.

    Confusion cells and losses are products of case values with counts, rank metrics come from score blocks.
    """
    eps = 2.220446049250313e-16
    q = X.clip("p", eps, 1.0 - eps)
    pos, pred = F.col("y") == 1, F.col("p") >= F.col("threshold_target")
    loss = -F.when(pos, F.ln(q)).otherwise(F.ln(F.lit(1.0) - q))
    valued = rows.select(
        (pos & pred).cast("double").alias("tp"), (~pos & ~pred).cast("double").alias("tn"), (~pos & pred).cast("double").alias("fp"),
        (pos & ~pred).cast("double").alias("fn"), F.pow(F.col("p") - F.col("y"), F.lit(2.0)).alias("square"), loss.alias("loss"), "counts",
    )
    cells = R.weighted_sums(valued, list(CELLS), replicates).withColumns({c: F.round(c).cast("long") for c in CELLS[:4]})
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    cells = metrics.rates(cells).withColumns({"brier_score": F.col("square") / n, "log_loss": F.col("loss") / n})
    ranks = R.rank_metrics(rows, replicates, block)
    two = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    return cells.where(two).join(ranks, "b").select("b", *BOOT_METRICS)


CALIBRATION = ("calibration_intercept", "calibration_slope")


def pooled_summary(oof: DataFrame, *, replicates: int = 2000, seed: int = 42, with_calibration: bool = True) -> DataFrame:
    """(metric, pooled, ci_low, ci_high, replicates, patients, cases) of held-out predictions pooled over repeats.

    A case counts once, with its mean score and mean threshold over all splits that held it out. Values of the pooled table and of all
    replicates come from the same packed cases: replicate 0 draws every patient once and is the table itself.
    """
    pooled = cut_lineage(metrics.pool_cases(oof))
    counts = R.packed_counts(pooled, replicates=replicates, seed=seed, with_whole=True)
    named = pooled.select("patientId", F.col("label").alias("y"), F.col("p_cancer").alias("p"), "threshold_target")
    rows = cut_lineage(named.join(cut_lineage(counts), "patientId"))
    values = replicate_metrics(rows, replicates + 1)
    names = list(BOOT_METRICS)
    if with_calibration:
        values = values.join(R.calibration(rows, replicates + 1), "b", "left")
        names += CALIBRATION
    long = values.select("b", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])))
    long = long.where(X.finite("value"))
    drawn = F.when(F.col("b") > 0, F.col("value"))
    # As many values of a metric as there are replicates.
    out = long.groupBy("metric").agg(
        F.max(F.when(F.col("b") == 0, F.col("value"))).alias("pooled"), F.percentile(drawn, 0.025).alias("ci_low"),
        F.percentile(drawn, 0.975).alias("ci_high"), F.count(drawn).alias("replicates"),
    )
    size = pooled.agg(F.count_distinct("patientId").alias("patients"), F.count(F.lit(1)).alias("cases"))
    return out.join(F.broadcast(size))  # one row


def bootstrap_intervals(replicates: DataFrame, *, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(metric, ci_low, ci_high) over the replicates; as many values as replicates, so bounded."""
    rows = replicates.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in BOOT_METRICS])).alias("z")
    ).select("z.metric", "z.value").where(X.finite("value"))
    return rows.groupBy("metric").agg(
        F.percentile("value", low).alias("ci_low"), F.percentile("value", high).alias("ci_high"),
        F.count(F.lit(1)).alias("replicates"),
    )


def bootstrap_calibration(cases: DataFrame, *, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Interval of calibration intercept and slope over the replicates."""
    fitted = R.calibration(packed_cases(cases, replicates=replicates, seed=seed), replicates)
    return fitted.agg(
        *[
            F.percentile(c, q).alias(f"{c}_{n}")
            for c in ("calibration_intercept", "calibration_slope") for n, q in (("ci_low", 0.025), ("ci_high", 0.975))
        ]
    )


def summary_with_intervals(summary: DataFrame, intervals: DataFrame, key: Sequence[str] = ("metric",)) -> DataFrame:
    """Left join of metric summary rows with their intervals."""
    return summary.join(intervals, list(key), "left")
