"""Two-stage gated logistic model: fits, scoring, patient-safe evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import scalars as X
from .. import schemas as S
from ..sources.storage import cut_lineage
from . import cases as cases_op
from . import filters, folds, metrics, ordered, signal

PROFILE_C = 0.1
FINAL_C = 0.1


def _numbers(values: Sequence[float]) -> Column:
    return F.expr("array(" + ",".join(f"{float(v)!r}D" for v in values) + ")")


def _scale_or_one(std: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return np.where(std <= 1e-12 * (1.0 + np.abs(mean)), 1.0, std)


def _fit_balanced(df: DataFrame, features: str, label: str, c: float) -> tuple[np.ndarray, float]:
    """L2 logistic with balanced class weights; the mean-loss penalty is 1 / (c * n)."""
    n, pos = df.agg(F.count(F.lit(1)), F.sum(label)).first()
    if not 0 < pos < n:
        raise ValueError(f"both classes are required: {pos} positive of {n}")
    weighted = df.withColumn(
        "_w", F.when(F.col(label) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
    )
    fitted = LogisticRegression(
        featuresCol=features, labelCol=label, weightCol="_w", regParam=1.0 / (c * n), elasticNetParam=0.0,
        standardization=False, tol=1e-10, maxIter=500, aggregationDepth=3,
    ).fit(weighted)
    return fitted.coefficients.toArray(), float(fitted.intercept)


@dataclass(frozen=True)
class ProfileModel:
    """First stage: standardised profile, logistic score. Scoring is one array expression."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float

    def probability(self, profile: Column | str = "radial_profile_data") -> Column:
        w = np.asarray(self.coef) / np.asarray(self.scale)
        b = self.intercept - float(np.dot(w, np.asarray(self.mean)))
        return X.expit(F.lit(b) + P.dot(X.col(profile), _numbers(w)))

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("p", self.probability())

    def parameters(self) -> list[tuple[str, int, float]]:
        named = {"lr1.mean": self.mean, "lr1.scale": self.scale, "lr1.coef": self.coef,
                 "lr1.intercept": (self.intercept,)}
        return [(k, i, float(v)) for k, vs in named.items() for i, v in enumerate(vs)]


def fit_profile_model(rows: DataFrame, *, c: float = PROFILE_C) -> ProfileModel:
    """Population-standardised profiles, then the balanced logistic fit."""
    data = rows.select(
        array_to_vector("radial_profile_data").alias("v"), X.binary_label("product_status_group").alias("label")
    )
    stats = data.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"), F.col("s.count").alias("n")
    ).first()
    n = stats["n"]
    mean = np.array(stats["mean"])
    scale = _scale_or_one(np.sqrt(np.maximum(np.array(stats["var"]) * (n - 1) / n, 0.0)), mean)
    z = F.zip_with(
        F.zip_with("radial_profile_data", _numbers(mean), lambda a, m: a - m), _numbers(scale), lambda a, s: a / s
    )
    scaled = rows.select(
        array_to_vector(z).alias("features"), X.binary_label("product_status_group").cast("double").alias("label")
    ).persist()
    try:
        coef, intercept = _fit_balanced(scaled, "features", "label", c)
    finally:
        scaled.unpersist()
    return ProfileModel(tuple(mean), tuple(scale), tuple(coef), intercept)


def gated_statistics(features: DataFrame) -> DataFrame:
    """One row of imputation medians, base mean / deviation and paired-row mean / deviation."""
    gate = F.col("symmetry_available") == 1
    cells = F.array(
        *[F.struct(F.lit(c).alias("name"), X.finite_or_null(F.col(c).cast("double")).alias("value")) for c in S.BASE3]
    )
    middle = ordered.quantiles(features.select(F.inline(cells)), "value", {"fill": 0.5}, ["name"])
    medians = middle.agg(
        *[F.coalesce(F.max(F.when(F.col("name") == c, F.col("fill"))), F.lit(0.0)).alias(f"fill_{c}") for c in S.BASE3]
    )
    filled = features.join(F.broadcast(medians))  # medians is one row
    value = lambda c: F.coalesce(X.finite_or_null(c), F.col(f"fill_{c}"))
    paired = lambda c: F.when(gate, X.finite_or_null(c))
    aggs = [F.first(f"fill_{c}").alias(f"fill_{c}") for c in S.BASE3]
    for c in S.BASE3:
        aggs += [F.avg(value(c)).alias(f"mean_{c}"), F.stddev_pop(value(c)).alias(f"std_{c}")]
    for c in S.CORE4:
        aggs += [
            F.coalesce(F.avg(paired(c)), F.lit(0.0)).alias(f"mean_{c}"),
            F.coalesce(F.stddev_pop(paired(c)), F.lit(1.0)).alias(f"std_{c}"),
        ]
    return filled.agg(*aggs)


def design_columns(stat: Callable[[str], Column]) -> dict[str, Column]:
    """The seven scaled columns; paired ones are zero while the gate is off."""
    gate = F.col("symmetry_available") == 1
    scale = lambda c: F.when(stat(f"std_{c}") > 1e-12, stat(f"std_{c}")).otherwise(F.lit(1.0))
    out = {}
    for c in S.BASE3:
        v = F.coalesce(X.finite_or_null(c), stat(f"fill_{c}"))
        out[f"x_{c}"] = (v - stat(f"mean_{c}")) / scale(c)
    for c in S.CORE4:
        v = F.coalesce(X.finite_or_null(c), stat(f"mean_{c}"))
        out[f"x_gated_{c}"] = F.when(gate, (v - stat(f"mean_{c}")) / scale(c)).otherwise(F.lit(0.0))
    return out


def design_matrix(features: DataFrame, stats: DataFrame) -> DataFrame:
    """Scaled design columns next to the features; ``stats`` is one row."""
    joined = features.join(F.broadcast(stats))
    return joined.withColumns(design_columns(F.col)).drop(*stats.columns)


class _GatedParams(Params):
    """Parameters of the final stage: inverse penalty, label and output column."""

    c = Param(Params._dummy(), "c", "inverse strength of the L2 penalty", TypeConverters.toFloat)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label column", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "column that the fitted stage adds", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(c=FINAL_C, labelCol="label", probabilityCol="p_cancer")


class GatedLogistic(Estimator, _GatedParams, DefaultParamsReadable, DefaultParamsWritable):
    """Final stage estimator: profile evidence, age, and gated paired features."""

    @keyword_only
    def __init__(self, *, c: float | None = None, labelCol: str | None = None, probabilityCol: str | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> GatedLogisticModel:
        stats = gated_statistics(dataset).first().asDict()
        names = list(design_columns(lambda k: F.lit(stats[k])))
        x = dataset.withColumns(design_columns(lambda k: F.lit(stats[k])))
        x = x.select(
            array_to_vector(F.array(*names)).alias("features"), F.col(self.getOrDefault("labelCol")).cast("double").alias("label")
        ).persist()
        try:
            coef, intercept = _fit_balanced(x, "features", "label", self.getOrDefault("c"))
        finally:
            x.unpersist()
        return self._copyValues(GatedLogisticModel(stats, tuple(float(v) for v in coef), intercept))


class _ModelWriter(MLWriter):
    """Params as metadata, fitted numbers as the parameter table."""

    def __init__(self, instance: GatedLogisticModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        parameter_table(self.sparkSession, self.instance).coalesce(1).write.parquet(f"{path}/parameters")


class _ModelReader(MLReader):
    def load(self, path: str) -> GatedLogisticModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        if not metadata["class"].endswith("GatedLogisticModel"):
            raise ValueError(f"{path} holds a {metadata['class']}")
        found = _final_of(_vectors(self.sparkSession.read.parquet(f"{path}/parameters")))
        found._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(found, metadata)
        return found


class GatedLogisticModel(Model, _GatedParams, MLWritable, MLReadable):
    """Fitted final stage; adds ``probabilityCol``. The gate itself is never a predictor."""

    def __init__(self, stats: dict, coef: tuple[float, ...], intercept: float):
        super().__init__()
        self.stats, self.coef, self.intercept = stats, coef, intercept

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for w, x in zip(self.coef, design_columns(lambda k: F.lit(self.stats[k])).values()):
            z = z + F.lit(float(w)) * x
        return X.expit(z)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOrDefault("probabilityCol"), self.probability())

    def parameters(self) -> list[tuple[str, int, float]]:
        rows = [(f"lr2.{k}", 0, float(v)) for k, v in sorted(self.stats.items())]
        rows += [("lr2.coef", i, float(v)) for i, v in enumerate(self.coef)]
        return rows + [("lr2.intercept", 0, float(self.intercept))]


def parameter_table(spark: SparkSession, *models) -> DataFrame:
    """(param, ix, value) of fitted parts; the model artifact is this table plus a metadata row."""
    rows = [r for m in models for r in m.parameters()]
    return spark.createDataFrame(rows, "param string, ix int, value double")


def _vectors(params: DataFrame) -> dict[str, tuple[float, ...]]:
    found: dict[str, dict[int, float]] = {}
    for r in params.collect():
        found.setdefault(r["param"], {})[r["ix"]] = r["value"]
    return {k: tuple(v[i] for i in sorted(v)) for k, v in found.items()}


def _final_of(found: dict[str, tuple[float, ...]]) -> GatedLogisticModel:
    stats = {k[4:]: v[0] for k, v in found.items() if k.startswith("lr2.") and k not in ("lr2.coef", "lr2.intercept")}
    return GatedLogisticModel(stats, found["lr2.coef"], found["lr2.intercept"][0])


def load_profile(params: DataFrame) -> ProfileModel:
    """First stage from its parameter table."""
    found = _vectors(params)
    return ProfileModel(found["lr1.mean"], found["lr1.scale"], found["lr1.coef"], found["lr1.intercept"][0])


def load_models(params: DataFrame) -> tuple[ProfileModel, GatedLogisticModel]:
    """Rebuild both stages from a parameter table (a few hundred rows)."""
    return load_profile(params), _final_of(_vectors(params))


# --- many fits at once -------------------------------------------------------------------------


@dataclass(frozen=True)
class Family:
    """Parameters of one logistic model per split, in scaled coordinates."""

    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    intercept: np.ndarray


#: Arrays of a block, and for a split its design rows with a mask of the cells that count.
Block = dict[str, np.ndarray]
Design = Callable[[Block], Callable[[int], tuple[np.ndarray, np.ndarray]]]


def pack_blocks(df: DataFrame) -> DataFrame:
    """One row of binary arrays for each Arrow batch: numbers as they are, arrays of equal length as matrices, all in doubles.

    Passes that read the same rows again and again neither decode nor copy them.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cells = []
            for c in b.columns:
                values = c.flatten() if pa.types.is_list(c.type) else c
                cells.append(values.cast(pa.float64()).to_numpy(zero_copy_only=False).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), *[pa.array([v], pa.binary()) for v in cells]], names=["_n", *names])

    return df.mapInArrow(run, "_n long, " + ", ".join(f"{n} binary" for n in names))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The arrays of packed rows; a column with one number a row is a vector."""
    for b in batches:
        names = [n for n in b.schema.names if n != "_n"]
        for i, n in enumerate(b.column("_n").to_pylist()):
            found = {}
            for name in names:
                v = np.frombuffer(b.column(name)[i].as_py(), np.float64)
                found[name] = v if len(v) == n else v.reshape(n, -1)
            yield found


def _sum_by_split(df: DataFrame, fn, width: int, splits: int) -> np.ndarray:
    """Sum over tasks of the matrix (split numbers, rows of sums) that ``fn`` makes of a task's blocks.

    A task gives one vector for each split whatever its row count; Spark adds them up with a partial
    vector aggregate. The driver receives splits x width numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = fn(blocks(batches))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), width).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(at, np.int32)), lists], names=["split", "v"])

    table = df.mapInArrow(run, "split int, v array<double>").groupBy("split").agg(Summarizer.sum(array_to_vector("v")).alias("s")).select(
        "split", vector_to_array("s").alias("s")
    ).toArrow()
    out = np.zeros((splits, width))
    if table.num_rows:
        flat = table.column("s").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out[table.column("split").to_numpy()] = flat.reshape(table.num_rows, width)
    return out


def fit_family(
    df: DataFrame, design: Design, p: int, *, repeats: int, fold_count: int, c: float,
    iterations: int = 100, tol: float = 1e-9,
) -> Family:
    """Balanced L2 logistic fits for all splits together.

    Rows are packed into blocks once and kept; every pass is one distributed job over the blocks: tasks form gradient and
    curvature of each split from matrix products, Spark sums them, the driver solves one small system per split. A row belongs to the
    training part of split (r, k) unless its fold in repeat r is k; rows are never copied per split. A split
    that does not settle fails the job. ``df`` has label, folds and what the design reads.
    """
    packed = pack_blocks(df).persist()
    try:
        return _fit_packed(packed, design, p, repeats=repeats, fold_count=fold_count, c=c, iterations=iterations, tol=tol)
    finally:
        packed.unpersist()


def _fit_packed(df: DataFrame, design: Design, p: int, *, repeats: int, fold_count: int, c: float, iterations: int, tol: float) -> Family:
    splits = repeats * fold_count
    own_repeat = np.repeat(np.arange(repeats), fold_count)
    own_fold = np.tile(np.arange(fold_count), repeats)

    def training_mask(block: Block) -> np.ndarray:
        f = block["folds"].reshape(len(block["label"]), -1)
        return f[:, own_repeat] != own_fold

    def moments(found):
        acc = np.zeros((splits, 2 + 2 * p))
        for block in found:
            mask, y, at = training_mask(block), block["label"], design(block)
            for s in range(splits):
                m = mask[:, s]
                x, v = at(s)
                xv = np.where(v, x, 0.0)[m]
                acc[s] += np.concatenate([[m.sum(), y[m].sum()], v[m].sum(0), xv.sum(0)])
        return range(splits), acc

    total = _sum_by_split(df, moments, 2 + 2 * p, splits)
    n, pos = total[:, 0], total[:, 1]
    if np.any((pos <= 0) | (pos >= n)):
        raise ValueError("a training split holds only one class")
    count = np.maximum(total[:, 2:2 + p], 1.0)
    mean = total[:, 2 + p:2 + 2 * p] / count

    def squares(found):
        # Around the known mean, so nothing cancels.
        acc = np.zeros((splits, p))
        for block in found:
            mask = training_mask(block)
            at = design(block)
            for s in range(splits):
                x, v = at(s)
                acc[s] += (np.where(v, x - mean[s], 0.0)[mask[:, s]] ** 2).sum(0)
        return range(splits), acc

    var = _sum_by_split(df, squares, p, splits) / count
    scale = np.where(var <= 1e-14 * (1.0 + mean**2), 1.0, np.sqrt(var))
    weight = np.stack([n / (2.0 * (n - pos)), n / (2.0 * pos)], axis=1)
    beta = np.zeros((splits, p + 1))
    live = np.ones(splits, dtype=bool)
    upper = np.triu_indices(p + 1)
    width = (p + 1) + len(upper[0])
    ridge = np.eye(p + 1) / c
    ridge[0, 0] = 0.0

    for _ in range(iterations):
        now, active = beta.copy(), np.flatnonzero(live)

        def curvature(found, now=now, active=active):
            acc = np.zeros((len(active), width))
            for block in found:
                mask, y, at = training_mask(block), block["label"].astype(int), design(block)
                for i, s in enumerate(active):
                    x, v = at(s)
                    z = np.where(v, (x - mean[s]) / scale[s], 0.0)
                    z = np.hstack([np.ones((len(z), 1)), z])
                    mu = 1.0 / (1.0 + np.exp(-(z @ now[s])))
                    w = mask[:, s] * weight[s][y]
                    g = z.T @ (w * (mu - y))
                    h = (z * (w * mu * (1.0 - mu))[:, None]).T @ z
                    acc[i] += np.concatenate([g, h[upper]])
            return active, acc

        sums = _sum_by_split(df, curvature, width, splits)
        for s in active:
            g = sums[s, :p + 1] + ridge @ beta[s]
            h = np.zeros((p + 1, p + 1))
            h[upper] = sums[s, p + 1:]
            h = h + np.triu(h, 1).T + ridge
            step = np.linalg.solve(h, g)
            beta[s] -= step * min(1.0, 10.0 / max(np.abs(step).max(), 1e-12))
            live[s] = np.abs(step).max() > tol
        if not live.any():
            break
    if live.any():
        raise ValueError(f"{int(live.sum())} of {splits} fits do not settle within {iterations} passes")
    return Family(mean, scale, beta[:, 1:], beta[:, 0])


def _profile_design(block: Block):
    x = block["x"].reshape(len(block["label"]), -1)
    v = np.ones(x.shape, dtype=bool)
    return lambda s: (x, v)


def _final_design(block: Block):
    evidence, rest = (block[k].reshape(len(block["label"]), -1) for k in ("evidence", "rest"))
    gate = block["symmetry_available"] == 1
    v = np.ones((len(rest), 7), dtype=bool)
    v[:, 3:] = gate[:, None]
    return lambda s: (np.hstack([evidence[:, s:s + 1], rest]), v)


def fold_arrays(assigned: DataFrame) -> DataFrame:
    """(patientId, folds): the fold of a patient in every repeat; as long as the repeat count."""
    listed = F.array_sort(F.collect_list(F.struct("repeat", "fold")))
    return assigned.groupBy("patientId").agg(F.transform(listed, lambda s: s["fold"]).alias("folds"))


def cross_validate(
    rows: DataFrame, features: DataFrame, assigned: DataFrame, *, grid_points: int, fold_count: int = 5, repeats: int = 20,
    profile_c: float = PROFILE_C, final_c: float = FINAL_C, target: float = 0.95,
    model_name: str = "two_stage_gated",
) -> tuple[DataFrame, DataFrame]:
    """(metric rows, held-out predictions) of all splits.

    ``rows`` are first-stage rows, ``features`` the case table without profile evidence; paired features
    do not depend on the split and are computed once. Thresholds come from training cases only.
    """
    splits = repeats * fold_count
    fold_of = fold_arrays(assigned)
    base = cut_lineage(
        rows.select(
            "patientId", X.side_norm("side").alias("target_side_norm"), F.col("radial_profile_data").alias("x"),
            X.binary_label("product_status_group").alias("label"),
        ).join(fold_of, "patientId")
    )
    first = fit_family(base.select("x", "label", "folds"), _profile_design, grid_points, repeats=repeats, fold_count=fold_count, c=profile_c)
    w = first.coef / first.scale
    b = first.intercept - (w * first.mean).sum(1)

    @F.pandas_udf("array<double>")
    def logits(x: pd.Series) -> pd.Series:
        z = np.stack(x.to_numpy()).astype(float) @ w.T + b
        lim = np.log((1.0 - X.EPS) / X.EPS)
        return pd.Series(list(np.clip(z, -lim, lim)))

    evidence = (
        base.groupBy("patientId", "target_side_norm")
        .agg(Summarizer.mean(array_to_vector(logits("x"))).alias("m"))
        .select(
            "patientId", "target_side_norm",
            F.transform(vector_to_array("m"), lambda v: X.expit(v)).alias("evidence"),
        )
    )
    rest = F.array(*[F.col(c).cast("double") for c in ("age", "age_available", *S.CORE4)])
    table = cut_lineage(
        features.select(
            "target_case_id", "patientId", "target_side_norm", "label", "symmetry_available", rest.alias("rest")
        ).join(evidence, ["patientId", "target_side_norm"]).join(fold_of, "patientId")
    )
    final = fit_family(table.select("evidence", "rest", "symmetry_available", "label", "folds"), _final_design, 7, repeats=repeats, fold_count=fold_count, c=final_c)
    wf = final.coef / final.scale

    def score(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            at = _final_design({
                "label": pdf["label"].to_numpy(), "symmetry_available": pdf["symmetry_available"].to_numpy(),
                **{c: np.stack(pdf[c].to_numpy()).astype(float) for c in ("evidence", "rest")},
            })
            f = np.stack(pdf["folds"].to_numpy())
            for s in range(splits):
                x, v = at(s)
                z = np.where(v, x - final.mean[s], 0.0) @ wf[s] + final.intercept[s]
                yield pd.DataFrame(
                    {
                        "split_id": s, "target_case_id": pdf["target_case_id"], "patientId": pdf["patientId"],
                        "label": pdf["label"].astype(int), "p_cancer": 1.0 / (1.0 + np.exp(-z)),
                        "role": np.where(f[:, s // fold_count] == s % fold_count, "test", "train"),
                    }
                )

    scored = cut_lineage(
        table.mapInPandas(
            score,
            "split_id int, target_case_id string, patientId string, label int, p_cancer double, role string",
        )
    )
    train = scored.where("role = 'train'")
    curve = metrics.score_curve(train, ["split_id"], y="label", p="p_cancer")
    points = metrics.roc_points(curve, ["split_id"], p="p_cancer")
    limits = metrics.thresholds(points, ["split_id"], target=target)
    # One threshold row per split.
    test = scored.where("role = 'test'").join(limits, "split_id").withColumns(
        {
            "model_name": F.lit(model_name), "evaluation_mode": F.lit("stratified_kfold"),
            "model_route": F.lit("default"),
        }
    )
    predictions = metrics.prediction_frame(test).drop("role")
    values = metrics.all_metrics(test, ["split_id"], y="label", p="p_cancer", threshold=F.col("threshold_target"))
    sizes = scored.groupBy("split_id").agg(
        F.count_distinct(F.when(F.col("role") == "train", F.col("patientId"))).alias("train_patients"),
        F.count_distinct(F.when(F.col("role") == "test", F.col("patientId"))).alias("test_patients"),
        F.count_if(F.col("role") == "train").alias("train_target_cases"),
        F.count_if(F.col("role") == "test").alias("test_target_cases"),
        F.count_if((F.col("role") == "train") & (F.col("label") == 1)).alias("train_cancer_target_cases"),
        F.count_if((F.col("role") == "test") & (F.col("label") == 1)).alias("test_cancer_target_cases"),
    )
    renamed = {c: f"{c}_target" for c in
               ("sensitivity", "specificity", "balanced_accuracy", "ppv", "npv", "tp", "tn", "fp", "fn")}
    rows_out = (
        values.withColumnsRenamed(renamed).join(sizes, "split_id").join(limits, "split_id")
        .withColumns(
            {
                "model_name": F.lit(model_name), "evaluation_mode": F.lit("stratified_kfold"),
                "selected_lr1_c": F.lit(profile_c), "selected_lr2_c": F.lit(final_c),
            }
        )
    )
    return rows_out, predictions


# --- complete training -------------------------------------------------------------------------


@dataclass(frozen=True)
class Fitted:
    """Frozen training result; DataFrames stay lazy and distributed."""

    profile: ProfileModel
    final: GatedLogisticModel
    thresholds: dict
    features: DataFrame
    scored: DataFrame
    policy: object
    split_metrics: DataFrame | None = None
    predictions: DataFrame | None = None
    #: Pooled held-out metrics with bootstrap intervals, a row for each metric.
    pooled: DataFrame | None = None


def case_features(rows: DataFrame, contract=None, *, shared_axis: bool = False, ambiguous: str = "fail") -> DataFrame:
    """Split-independent case table: patient roll-up, gate and paired features."""
    from . import asymmetry

    contract = contract or asymmetry.CURRENT
    cases = cases_op.target_cases(rows, ambiguous=ambiguous)
    sides = asymmetry.side_profiles(rows, contract, shared_axis=shared_axis)
    pairs = asymmetry.pair_features(cases, sides, contract)
    return cases.join(cases_op.patient_rollup(rows), "patientId").join(pairs, "target_case_id")


def train(rows: DataFrame, *, evaluate: bool = False, grid_points: int, fold_count: int = 5, repeats: int = 20,
          seed: int = 42, target: float = 0.95, profile_c: float = PROFILE_C, final_c: float = FINAL_C,
          shared_axis: bool = False, bootstrap: int = 2000, ambiguous: str = "fail") -> Fitted:
    """Features, optional patient-safe evaluation with pooled values and intervals, final fit, threshold and tier policy."""
    from . import tiers

    rows = signal.require_profiles(cut_lineage(rows))
    admitted = filters.require_two_classes(filters.stage1_rows(rows))
    base = cut_lineage(case_features(rows, shared_axis=shared_axis, ambiguous=ambiguous))
    split_metrics = predictions = pooled = None
    if evaluate:
        assigned = folds.assign_folds(base, folds=fold_count, repeats=repeats, seed=seed)
        split_metrics, predictions = cross_validate(
            admitted, base, assigned, grid_points=grid_points, fold_count=fold_count, repeats=repeats,
            profile_c=profile_c, final_c=final_c, target=target,
        )
        pooled = folds.pooled_summary(predictions, replicates=bootstrap, seed=seed)
    first = fit_profile_model(admitted, c=profile_c)
    scores = cases_op.case_scores(base, first.score(admitted))
    features = cut_lineage(cases_op.reliability(base.join(scores, "target_case_id")))
    final = GatedLogistic(c=final_c).fit(features)
    scored = cut_lineage(final.transform(features))
    points = metrics.roc_points(metrics.score_curve(scored, y="label", p="p_cancer"), p="p_cancer")
    limits = metrics.thresholds(points, target=target).first().asDict()
    policy = tiers.fit_policy(predictions, limits["threshold_target"])
    return Fitted(first, final, limits, features, scored, policy, split_metrics, predictions, pooled)
