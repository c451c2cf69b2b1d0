"""Score curves, thresholds and binary metrics, globally or per key (split, replicate)."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import newton, ordered

INF = float("inf")


def score_curve(
    df: DataFrame, by: Sequence[str] = (), *, y: str = "y", p: str = "p", weight: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """One row per (by, distinct score), descending: pos, neg, running tp and fp, totals."""
    w = F.col(weight) if weight else F.lit(1)
    curve = ordered.running_totals(
        df, p, {"pos": w * F.col(y), "neg": w * (1 - F.col(y))}, by, descending=True, partitions=partitions
    )
    return curve.withColumnsRenamed(
        {"pos_cum": "tp", "neg_cum": "fp", "pos_all": "positives", "neg_all": "negatives"}
    )


def roc_points(curve: DataFrame, by: Sequence[str] = (), *, p: str = "p") -> DataFrame:
    """ROC corners: first, last and points where the step changes. The (inf, 0, 0) start is implied."""
    first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    last = F.col("pos_next").isNull()
    turn = (F.col("pos") != F.col("pos_next")) | (F.col("neg") != F.col("neg_next"))
    return curve.where(first | last | turn).select(
        *by, F.col(p).alias("threshold"),
        X.ratio(F.col("tp"), F.col("positives")).alias("tpr"),
        X.ratio(F.col("fp"), F.col("negatives")).alias("fpr"),
    )


def thresholds(points: DataFrame, by: Sequence[str] = (), *, target: float = 0.95) -> DataFrame:
    """Youden and target-sensitivity thresholds per key.

    Youden is the first maximum in descending-score order, the start (score inf, 0) included. The target
    threshold has the lowest false-positive rate among points reaching the sensitivity, then the highest
    score; when no point reaches it, the Youden threshold is used.
    """
    j = F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("j"), F.col("threshold").alias("t")))
    reach = F.col("tpr") >= F.lit(float(target))
    hit = F.min(F.when(reach, F.struct(F.col("fpr").alias("f"), (-F.col("threshold")).alias("t"))))
    agg = points.groupBy(*by).agg(j.alias("_j"), hit.alias("_h"))
    youden = F.when(F.col("_j.j") > 0, F.col("_j.t")).otherwise(F.lit(INF))
    chosen = F.when(F.lit(target <= 0.0), F.lit(INF)).when(F.col("_h").isNotNull(), -F.col("_h.t")).otherwise(youden)
    return agg.select(
        *by, youden.alias("threshold_youden"), chosen.alias("threshold_target"),
        F.lit(float(target)).alias("target_sensitivity"),
        (F.col("_h").isNotNull() | F.lit(target <= 0.0)).alias("target_reached"),
    )


def rank_metrics(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC (tie-averaged) and average precision from the score curve; null for a missing class."""
    above = (F.col("tp") - F.col("pos")).cast("double")
    area = F.sum(F.col("neg") * (above + F.col("pos") / 2.0))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    ap = F.sum(F.col("pos") * precision)
    positives, negatives = F.max("positives"), F.max("negatives")
    both = (positives > 0) & (negatives > 0)
    return curve.groupBy(*by).agg(
        F.when(both, area / (positives.cast("double") * negatives)).alias("roc_auc"),
        F.when(positives > 0, ap / positives).alias("pr_auc"),
    )


def confusion_metrics(
    df: DataFrame, by: Sequence[str] = (), *, y: str = "y", p: str = "p", threshold: Column, weight: Column | None = None
) -> DataFrame:
    """Counts and rates at per-row thresholds; zero denominators give null."""
    w = weight if weight is not None else F.lit(1)
    pred = F.col(p) >= threshold
    cell = lambda cond: F.sum(F.when(cond, w).otherwise(F.lit(0)))
    pos = F.col(y) == 1
    out = df.groupBy(*by).agg(
        cell(pos & pred).alias("tp"), cell(~pos & ~pred).alias("tn"),
        cell(~pos & pred).alias("fp"), cell(pos & ~pred).alias("fn"),
    )
    return rates(out)


def rates(df: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = df.withColumns(
        {
            "sensitivity": X.ratio(tp, tp + fn), "specificity": X.ratio(tn, tn + fp),
            "ppv": X.ratio(tp, tp + fp), "npv": X.ratio(tn, tn + fn),
        }
    )
    sens, spec = F.col("sensitivity"), F.col("specificity")
    return out.withColumn("balanced_accuracy", F.coalesce((sens + spec) / 2.0, sens, spec))


def loss_metrics(
    df: DataFrame, by: Sequence[str] = (), *, y: str = "y", p: str = "p", weight: Column | None = None
) -> DataFrame:
    """Brier score and log loss (probabilities clipped at double resolution)."""
    w = weight if weight is not None else F.lit(1)
    eps = float(np.finfo(float).eps)
    q = X.clip(p, eps, 1.0 - eps)
    loss = -F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(F.lit(1.0) - q))
    square = F.pow(F.col(p) - F.col(y), F.lit(2.0))
    return df.groupBy(*by).agg(
        (F.sum(w * square) / F.sum(w)).alias("brier_score"), (F.sum(w * loss) / F.sum(w)).alias("log_loss")
    )


def calibration(
    df: DataFrame, by: Sequence[str] = (), *, y: str = "y", p: str = "p", weight: Column | None = None,
    c: float = 1e6, iterations: int = 60,
) -> DataFrame:
    """Calibration intercept and slope per key: logistic of y on the clipped logit, slope penalty 1/c.

    Keys are splits, models or the like: their list is kept on the driver with two numbers each. All advance together over rows
    that are packed into blocks once and kept for all passes; a pass is six sums per key. Keys of one class, and
    keys whose curvature vanishes before the optimum (perfectly separated scores), give null. A key that does not settle fails the job.
    """
    by = list(by)
    w = weight if weight is not None else F.lit(1.0)
    base = df.select(*by, X.logit(p).alias("_x"), F.col(y).cast("double").alias("_y"), w.cast("double").alias("_w"))
    seen = base.groupBy(*by).agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi")).collect()
    spark, names = df.sparkSession, ("calibration_intercept", "calibration_slope")
    if by:
        listed = spark.createDataFrame(
            [(*[r[k] for k in by], i) for i, r in enumerate(seen)],
            ", ".join([*[f"`_{i}` {base.schema[k].dataType.simpleString()}" for i, k in enumerate(by)], "_k int"]),
        )
        same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(by)])
        base = base.join(F.broadcast(listed), same)  # a row for each key
    else:
        base = base.withColumn("_k", F.lit(0))
    packed = newton.pack_rows(base.select(*[F.col(f"_{n}").alias(n) for n in ("k", "x", "y", "w")])).persist()
    try:
        one_class = np.array([r["_lo"] is None or r["_lo"] == r["_hi"] for r in seen], bool)
        fit = newton.solve(packed, len(seen), newton.row_sums(len(seen)), one_class, c=c, iterations=iterations)
    finally:
        packed.unpersist()
    found = [(float(a), float(b)) if ok else (None, None) for a, b, ok in zip(fit.a, fit.b, fit.status == newton.SETTLED)]
    schema = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by], *[f"{n} double" for n in names]])
    return spark.createDataFrame([(*[r[k] for k in by], *v) for r, v in zip(seen, found)], schema)


def all_metrics(
    df: DataFrame, by: Sequence[str] = (), *, y: str = "y", p: str = "p", threshold: Column,
    with_calibration: bool = True,
) -> DataFrame:
    """Every metric of a key in one row. All parts are one row per key, joined on the key."""
    by = list(by)
    key = by or ["_one"]
    if not by:
        df = df.withColumn("_one", F.lit(1))
    out = confusion_metrics(df, key, y=y, p=p, threshold=threshold)
    out = out.join(rank_metrics(score_curve(df, key, y=y, p=p), key), key)
    out = out.join(loss_metrics(df, key, y=y, p=p), key)
    if with_calibration:
        out = out.join(calibration(df, key, y=y, p=p), key)
    return out if by else out.drop("_one")


def fit_record(df: DataFrame, threshold: float, *, y: str = "label", p: str = "p_cancer") -> DataFrame:
    """In-sample record of the final fit, flagged as not independent."""
    m = all_metrics(df, y=y, p=p, threshold=F.lit(float(threshold)))
    return m.select(
        F.lit("in_sample_not_independent").alias("evaluation_status"),
        (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("target_cases"),
        (F.col("tp") + F.col("fn")).alias("cancer_target_cases"),
        (F.col("tn") + F.col("fp")).alias("benign_target_cases"),
        F.lit(float(threshold)).alias("decision_threshold"),
        "roc_auc", "pr_auc", "sensitivity", "specificity", "balanced_accuracy", "ppv", "npv",
        "brier_score", "log_loss", "calibration_intercept", "calibration_slope",
        F.col("tp").alias("true_positives"), F.col("tn").alias("true_negatives"),
        F.col("fn").alias("false_negatives"), F.col("fp").alias("false_positives"),
    )


SUMMARY_WITH_STD = ("roc_auc", "pr_auc", "brier_score", "log_loss", "sensitivity_target", "specificity_target")
SUMMARY_MEANS = ("balanced_accuracy_target", "ppv_target", "npv_target", "calibration_intercept", "calibration_slope")
SUMMARY_COUNTS = {"tp": "true_positives", "tn": "true_negatives", "fn": "false_negatives", "fp": "false_positives"}


def summarise_splits(df: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """Mean and population deviation of the fold metrics over splits."""
    aggs = [F.count(F.lit(1)).alias("splits")]
    for m in SUMMARY_WITH_STD:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    aggs += [F.avg(m).alias(f"{m}_mean") for m in SUMMARY_MEANS if m in df.columns]
    aggs += [F.avg(f"{k}_target").alias(f"{v}_mean") for k, v in SUMMARY_COUNTS.items()]
    return df.groupBy(*by).agg(*aggs)


def held_out_extract(summary: DataFrame) -> DataFrame:
    """The three metrics frozen with the model."""
    pair = lambda n, c: F.struct(F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std")).alias(n)
    return summary.select(
        F.struct(pair("roc_auc", "roc_auc"), pair("sensitivity", "sensitivity_target"),
                 pair("specificity", "specificity_target")).alias("held_out_metrics")
    )


def pool_cases(oof: DataFrame) -> DataFrame:
    """One row per case over its held-out predictions: label, mean score, mean threshold."""
    return oof.groupBy("target_case_id").agg(
        F.min("patientId").alias("patientId"), F.min("label").alias("label"),
        F.avg("p_cancer").alias("p_cancer"), F.avg("threshold_target").alias("threshold_target"),
    )


def prediction_frame(df: DataFrame) -> DataFrame:
    """Held-out prediction rows with the predicted class."""
    return df.withColumn("label_name", X.label_name("label")).withColumn(
        "y_pred_target", (F.col("p_cancer") >= F.col("threshold_target")).cast("int")
    )


def reference_scores(df: DataFrame, *, y: str = "y", p: str = "p") -> DataFrame:
    """Frozen reference distribution: (population, score, n), one row per distinct finite score."""
    ok = df.where(X.finite(p))
    populations = F.array(
        F.lit("all_target_cases"),
        F.when(F.col(y) == 1, "cancer_target_cases").otherwise("benign_target_cases"),
    )
    return ok.select(F.explode(populations).alias("population"), F.col(p).alias("score")).groupBy(
        "population", "score"
    ).agg(F.count(F.lit(1)).alias("n"))


def score_percentiles(queries: DataFrame, reference: DataFrame, *, p: str = "p", y: str = "y") -> DataFrame:
    """Share of finite reference scores at or below each query score: all, negative, positive.

    Queries and references are merged into one ordered running count, so neither side is broadcast
    and no pair of rows is formed. Queries without a finite score have null percentiles. A reference
    without one of the classes fails the job.
    """
    zero = F.lit(0)
    merged = reference.where(X.finite(p)).select(
        F.col(p).alias("_s"), F.lit(1).alias("n"), F.col(y).alias("pos"), (1 - F.col(y)).alias("neg")
    ).unionByName(
        queries.where(X.finite(p)).select(F.col(p).alias("_s")).distinct().select(
            "_s", zero.alias("n"), zero.alias("pos"), zero.alias("neg"))
    )
    run = ordered.running_totals(merged, "_s", {c: F.col(c) for c in ("n", "pos", "neg")})
    missing = F.raise_error(F.lit("reference scores need both classes")).cast("double")
    both = (F.col("pos_all") > 0) & (F.col("neg_all") > 0)
    run = run.select(
        F.col("_s").alias(p),
        F.when(both, X.ratio(F.col("n_cum"), F.col("n_all"))).otherwise(missing).alias("percentile_all"),
        X.ratio(F.col("neg_cum"), F.col("neg_all")).alias("percentile_reference_class"),
        X.ratio(F.col("pos_cum"), F.col("pos_all")).alias("percentile_target_class"),
    )
    return queries.join(run, p, "left")


def parameter_diff(left: DataFrame, right: DataFrame, *, rtol: float = 1e-12, atol: float = 1e-12) -> DataFrame:
    """Parameters (param, ix, value) of two runs that differ beyond tolerance or exist on one side only."""
    l = left.select("param", "ix", F.col("value").alias("left_value"), F.lit(True).alias("_l"))
    r = right.select("param", "ix", F.col("value").alias("right_value"), F.lit(True).alias("_r"))
    a, b = F.col("left_value"), F.col("right_value")
    close = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    same = (F.isnan(a) & F.isnan(b)) | a.eqNullSafe(b) | close
    status = (
        F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
        .when(~F.coalesce(same, F.lit(False)), "differs")
    )
    return l.join(r, ["param", "ix"], "full_outer").select(
        "param", "ix", "left_value", "right_value", status.alias("status")
    ).where("status is not null")


def curve_rank(df: DataFrame, *, p: str = "p") -> DataFrame:
    """Self-referencing empirical percentile of every distinct score."""
    run = ordered.running_totals(df, p, {"n": F.lit(1)})
    return run.select(p, F.col("n"), X.ratio(F.col("n_cum"), F.col("n_all")).alias("percentile"))
