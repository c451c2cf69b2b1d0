"""Calibration-quality study over calibrant profiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import resampling as R
from ..functions import scalars as X
from ..sources import storage
from . import filters, ordered

# Fixed values of the study.
D_SPACING_NM = 5.838
BETA_RATIO = 0.886
THICKNESS_CHANGE, THICKNESS_BEFORE, THICKNESS_AFTER = "2026-05-01", 40.0, 10.0
MAX_DISTANCE_MM = 500.0
MAX_SCORE = 0.0075
BETA_HALF, MIN_ORDER = 0.12, 3
FIT_LEFT, FIT_RIGHT = 0.03, 0.18
MIN_FIT_POINTS = 10


# --- manifest ----------------------------------------------------------------------------------


def manifest(sets: DataFrame) -> DataFrame:
    """Flat calibration manifest: JSON provenance, scalar acquisition fields, flags, parsed time."""
    names = ("data_batch", "source_line", "nova_range", "human1_version", "protocol_version")
    # One parse per row, whatever number of fields is used.
    fields = ", ".join(f"{n}: string" for n in names)
    parsed = F.from_json("metadata", f"backfill_provenance struct<{fields}>")
    return sets.withColumn("_p", parsed).select(
        "file_path", "file_name", "session_uid",
        F.try_to_timestamp("started_at").alias("started_at"),
        "set_name", "measurement_type_name", "measurement_type_category",
        *[F.col(f"_p.backfill_provenance.{n}").alias(n) for n in names],
        F.col("distance").alias("distance_mm"), F.col("exposure_time").alias("exposure_time_s"),
        F.col("poni").isNotNull().alias("has_poni"), F.col("raw_file").isNotNull().alias("has_raw_file"),
    )


def in_manifest_order(df: DataFrame) -> DataFrame:
    """Stable order: time (missing last), file name, set name."""
    return df.orderBy(F.col("started_at").asc_nulls_last(), "file_name", "set_name")


def session_catalogue(sets: DataFrame) -> DataFrame:
    """Sessions and rows per category."""
    per = sets.groupBy("measurement_type_category", "session_uid").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("measurement_type_category").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("rows")
    )


def select_calibrants(df: DataFrame, batches: Sequence[str], *, per_batch: int | None = None) -> DataFrame:
    """Calibrant sets of the batches with geometry and raw file; optionally the first k of each batch."""
    out = df.where(
        F.col("measurement_type_name").ilike("%silver behenate%") & F.col("data_batch").isin(*batches)
        & F.col("has_poni") & F.col("has_raw_file")
    )
    if per_batch is None:
        return out
    return ordered.first_k(
        out, ["data_batch"], [F.col("started_at").asc_nulls_last(), F.col("file_name")], per_batch
    )


def within_distance(df: DataFrame, max_mm: float = MAX_DISTANCE_MM) -> DataFrame:
    d = X.to_number("distance_mm")
    return df.where(X.finite(d) & (d <= max_mm))


def distance_stats(df: DataFrame, max_mm: float = MAX_DISTANCE_MM) -> DataFrame:
    """Rows in, passed and dropped, and the batches losing rows (the set of batches is a short fixed list)."""
    d = X.to_number("distance_mm")
    ok = F.coalesce(X.finite(d) & (d <= max_mm), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(ok).alias("rows_pass"), F.count_if(~ok).alias("rows_dropped"),
        F.array_join(F.array_sort(F.collect_set(F.when(~ok, F.col("data_batch")))), ",").alias("dropped_batches"),
    )


def latest_k(df: DataFrame, day: str, k: int) -> DataFrame:
    """Latest k rows up to and including a day, ascending. Top-k is kept per task, then merged."""
    upto = df.where(F.to_date("started_at") <= F.lit(day).cast("date"))
    return upto.orderBy(F.desc("started_at"), F.desc("file_name")).limit(k).orderBy("started_at", "file_name")


def worst(df: DataFrame, score: str, k: int = 1) -> DataFrame:
    """Highest scores first; ties by session id."""
    return df.orderBy(F.desc(score), "session_uid").limit(k)


def effective_thickness(
    df: DataFrame, *, change: str = THICKNESS_CHANGE, before: float = THICKNESS_BEFORE, after: float = THICKNESS_AFTER
) -> DataFrame:
    """Calibrant thickness by date with the rule in words; null without a date."""
    started = F.col("started_at").cast("timestamp_ntz")
    cut = F.lit(change).cast("timestamp_ntz")
    rule = f"started_at < {change}: {before} mm; started_at >= {change}: {after} mm"
    return df.withColumns(
        {
            "agbh_calibrant_thickness_mm": F.when(started < cut, F.lit(before)).when(started >= cut, F.lit(after)),
            "agbh_calibrant_thickness_rule": F.lit(rule),
        }
    )


ENRICH = (
    "data_batch", "source_line", "nova_range", "human1_version", "protocol_version", "file_name", "distance_mm",
    "agbh_calibrant_thickness_mm", "agbh_calibrant_thickness_rule",
)


def enrich(frames: DataFrame, rows: DataFrame, key: str = "file_path") -> DataFrame:
    """Copy the available manifest columns on to frames by file path (left join, size-based strategy)."""
    columns = [c for c in ENRICH if c in rows.columns and c != key]
    keep = [c for c in frames.columns if c not in columns]
    return frames.select(*keep).join(rows.select(key, *columns), key, "left")


def run_counts(sets: DataFrame, selected: DataFrame, integrated: DataFrame, reference: DataFrame) -> DataFrame:
    """(item, n): totals, selected, integrated, per batch, reference."""
    one = lambda d, n: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("item"), "n")
    batches = integrated.groupBy("data_batch").agg(F.count(F.lit(1)).alias("n")).where("data_batch is not null")
    return (
        one(sets, "calibration_sets_total").unionByName(one(selected, "selected_agbh_sets"))
        .unionByName(one(integrated, "integrated_agbh_sets"))
        .unionByName(batches.select(F.concat(F.lit("batch="), F.col("data_batch")).alias("item"), "n"))
        .unionByName(one(reference, "reference_agbh_sets"))
    )


def batch_policy(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """use / exclude / review per row by batch, the null key matched as a key."""
    r = rules.select(
        F.col("data_batch").alias("_b"), F.col("product_batch_usable_for_kalpha_only").alias("_u"),
        F.lit(True).alias("_known"),
    )
    usable = F.when(F.col("_u"), "use").when(~F.col("_u"), "exclude").otherwise("review")
    return rows.join(r, rows["data_batch"].eqNullSafe(r["_b"]), "left").withColumn(
        "batch_policy", usable
    ).drop("_b", "_u", "_known")


# --- grid tables: sizes depend on parameters only ----------------------------------------------


def peaks(q_max: float, *, d: float = D_SPACING_NM, ratio: float = BETA_RATIO) -> list[tuple[int, float, float]]:
    q1 = 2.0 * math.pi / d
    return [(k, k * q1, k * q1 * ratio) for k in range(1, int(math.floor(q_max / q1)) + 1)]


def peak_windows(
    q_min: float, q_max: float, *, ratio: float = BETA_RATIO, half: float = BETA_HALF, min_order: int = MIN_ORDER
) -> list[tuple[int, float, float, float]]:
    """(order, alpha, beta, right control) with both windows inside the range."""
    out = []
    for k, alpha, beta in peaks(q_max, ratio=ratio):
        control = alpha + (alpha - beta)
        if k >= min_order and beta - half >= q_min and control + half <= q_max:
            out.append((k, alpha, beta, control))
    return out


def grid_rows(lo: float, hi: float, points: int) -> np.ndarray:
    return np.linspace(float(lo), float(hi), int(points))


def fit_mask(
    grid: np.ndarray, q_min: float, q_max: float, *, left: float = FIT_LEFT, right: float = FIT_RIGHT,
    half: float = BETA_HALF, min_order: int = MIN_ORDER, ratio: float = BETA_RATIO,
) -> np.ndarray:
    """Grid points near alpha peaks and outside every beta window."""
    alpha = np.array([a for k, a, _ in peaks(q_max) if k >= min_order])
    beta = np.array([b for _, _, b, _ in peak_windows(q_min, q_max, ratio=ratio, half=half, min_order=min_order)])
    g = grid[:, None]
    near = ((g >= alpha - left) & (g <= alpha + right)).any(axis=1)
    inside = ((g >= beta - half) & (g <= beta + half)).any(axis=1) if len(beta) else np.zeros(len(grid), bool)
    return near & ~inside


def trapezoid_weights(q: np.ndarray) -> np.ndarray:
    """Weights w with sum(w * y) equal to the trapezoid integral of y over q."""
    if len(q) < 2:
        return np.zeros(len(q))
    w = np.zeros(len(q))
    step = np.diff(q)
    w[:-1] += step / 2.0
    w[1:] += step / 2.0
    return w


def on_grid(df: DataFrame, lo: float, hi: float, points: int, name: str = "yn") -> DataFrame:
    """Profile on the study grid, scaled to [0, 1]."""
    return df.withColumn(name, R.resample(lo, hi, points, scaled=True)("q_range", "radial_profile_data"))


def reference_curve(reference: DataFrame, lo: float, hi: float, points: int) -> DataFrame:
    """(i, ref): pointwise median over the selected reference profiles.

    The reference is a fixed small number of calibrations, so a point's median sees only that many values.
    """
    ys = on_grid(reference, lo, hi, points)
    return ys.select(F.posexplode("yn").alias("i", "v")).groupBy("i").agg(F.median("v").alias("ref"))


def curve_values(curve: DataFrame, points: int) -> np.ndarray:
    """The curve as one array on the driver: a number for each grid point, a parameter of all that follows."""
    out = np.full(points, np.nan)
    for r in curve.collect():
        out[r["i"]] = r["ref"]
    return out


def moved_curve(curve: np.ndarray, step: float, shift: float) -> np.ndarray:
    """The curve moved by ``shift``; points moved in from outside the grid are NaN. Linear between two neighbours."""
    at = np.arange(len(curve)) - shift / step
    lo = np.floor(at).astype(int)
    t = at - lo
    padded = np.concatenate([curve, [np.nan]])
    value = lambda k: padded[np.where((k >= 0) & (k < len(curve)), k, len(curve))]
    return np.where(t == 0, value(lo), value(lo) + (value(lo + 1) - value(lo)) * t)


# --- metrics: projections with constant matrices, one pass over the rows -----------------------


def mask_mean(df: DataFrame, mask: np.ndarray, lo: float, hi: float) -> DataFrame:
    """``fit_points`` and ``fit_mean`` of every profile: number and mean of its grid points in the mask; null without profile."""
    grid = grid_rows(lo, hi, len(mask))
    n = int(mask.sum())

    @F.arrow_udf("double")
    def mean(q: pa.Array, y: pa.Array) -> pa.Array:
        out, there = np.zeros(len(q)), np.zeros(len(q), bool)
        for rows, values in R.on_grid(q, y, grid, scaled=True):
            out[rows], there[rows] = values[:, mask].mean(axis=1) if n else np.nan, True
        return pa.array(out, mask=~there)

    found = df.withColumn("fit_mean", mean("q_range", "radial_profile_data"))
    return found.withColumn("fit_points", F.when(F.col("fit_mean").isNotNull(), F.lit(n).cast("long")))


def _filled(columns: dict[str, np.ndarray], there: np.ndarray) -> pa.StructArray:
    """A struct of doubles or lists of doubles, null where a row has no result."""
    fields = []
    for v in columns.values():
        if v.ndim == 1:
            fields.append(pa.array(v, mask=~there))
        else:
            fields.append(pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64())))
    return pa.StructArray.from_arrays(fields, names=list(columns), mask=pa.array(~there))


SHOULDER = ("shoulder_positive_area", "shoulder_peak_residual", "reference_fit_scale", "reference_fit_offset")


def shoulder_metric(
    df: DataFrame, reference: DataFrame, *, q_min: float, q_max: float, shoulder: tuple[float, float], points: int = 500,
) -> DataFrame:
    """Positive residual in one fixed shoulder after a scale + offset fit to the reference outside it.

    Scale and offset are two dot products of a profile with rows of one fixed matrix. Profiles without finite point have no row.
    """
    grid = grid_rows(q_min, q_max, points)
    curve = curve_values(reference_curve(reference, q_min, q_max, points), points)
    known = np.isfinite(curve)
    inside = (grid >= shoulder[0]) & (grid <= shoulder[1]) & known
    outside = known & ~inside
    weights = trapezoid_weights(grid[inside])
    solve = _projection(np.column_stack([curve[outside], np.ones(int(outside.sum()))]))

    @F.arrow_udf(", ".join(f"{n} double" for n in SHOULDER))
    def measure(q: pa.Array, y: pa.Array) -> pa.Array:
        out, there = np.full((len(q), len(SHOULDER)), np.nan), np.zeros(len(q), bool)
        for rows, values in R.on_grid(q, y, grid, scaled=True):
            there[rows] = True
            if solve is None:
                continue
            scale, offset = solve @ values[:, outside].T
            left = values[:, inside] - scale[:, None] * curve[inside] - offset[:, None]
            out[rows, 0] = np.clip(left, 0.0, None) @ weights
            out[rows, 1] = left.max(axis=1, initial=-np.inf)
            out[rows, 2], out[rows, 3] = scale, offset
        return _filled({n: out[:, k] for k, n in enumerate(SHOULDER)}, there)

    found = df.select("vec_id", measure("q_range", "radial_profile_data").alias("_m")).where("_m is not null")
    width = float(shoulder[1] - shoulder[0])
    named = found.select("vec_id", *[F.nullif(F.col(f"_m.{n}"), F.lit(float("nan"))).alias(n) for n in SHOULDER])
    return named.withColumn("shoulder_mean_positive_residual", F.col("shoulder_positive_area") / width)


def _projection(design: np.ndarray) -> np.ndarray | None:
    """Matrix that gives least-squares coefficients from values; none for a design without full rank."""
    if len(design) < design.shape[1] or not design.shape[1] == np.linalg.matrix_rank(design):
        return None
    return np.linalg.pinv(design)


FIT = ("fit_mean_square", "reference_q_shift_nm_inv", "reference_fit_scale", "reference_fit_offset", "reference_fit_linear_background")


def fit_to_reference(
    curve: np.ndarray, *, q_min: float, q_max: float, shifts: Sequence[float], half: float, min_order: int, min_points: int = MIN_FIT_POINTS,
):
    """Arrow function: best fit of scale, offset, slope and shift, and clipped areas of the beta and control windows.

    The moved reference, its design matrix on the fit mask and the matrix that solves it are made once for each shift; a profile
    needs three dot products and a residual for each shift, and the window areas of the best one (the smallest shift on ties).
    """
    points = len(curve)
    grid = grid_rows(q_min, q_max, points)
    windows = peak_windows(q_min, q_max, half=half, min_order=min_order)
    mask = fit_mask(grid, q_min, q_max, half=half, min_order=min_order)
    slope = grid - float(grid.mean())
    step = (q_max - q_min) / (points - 1)
    models = []
    for shift in sorted(float(s) for s in shifts):
        moved = moved_curve(curve, step, shift)
        known = np.isfinite(moved)
        at = np.flatnonzero(mask & known)
        design = np.column_stack([moved[at], np.ones(len(at)), slope[at]])
        solve = _projection(design) if len(at) >= min_points else None
        if solve is None:
            continue
        # Trapezoid weights of every window over the points that the moved reference covers.
        weights = np.zeros((points, 2 * len(windows)))
        for k, (_, _, beta, control) in enumerate(windows):
            for j, c in ((k, beta), (len(windows) + k, control)):
                near = np.flatnonzero((grid >= c - half) & (grid <= c + half))
                weights[near, j] = trapezoid_weights(grid[near])
        weights[~known] = 0.0
        used = np.flatnonzero(weights.any(axis=1))
        models.append((shift, at, design, solve, used, moved[used], weights[used]))
    kinds = ", ".join(f"{n} double" for n in FIT) + ", areas array<double>"

    @F.arrow_udf(kinds)
    def measure(q: pa.Array, y: pa.Array) -> pa.Array:
        n = len(q)
        out, areas, there = np.zeros((n, len(FIT))), np.zeros((n, 2 * len(windows))), np.zeros(n, bool)
        for rows, values in R.on_grid(q, y, grid, scaled=True):
            best, chosen, coefficients = np.full(len(rows), np.inf), np.full(len(rows), -1), np.zeros((len(rows), 3))
            for m, (_, at, design, solve, *_) in enumerate(models):
                have = values[:, at]
                x = have @ solve.T
                mse = np.square(have - x @ design.T).mean(axis=1)
                better = mse < best
                best[better], chosen[better], coefficients[better] = mse[better], m, x[better]
            there[rows] = chosen >= 0
            for m, (shift, _, _, _, used, moved, weights) in enumerate(models):
                own = np.flatnonzero(chosen == m)
                if not len(own):
                    continue
                a, b, c = coefficients[own].T[:, :, None]
                left = np.clip(values[own][:, used] - (a * moved + b + c * slope[used]), 0.0, None)
                areas[rows[own]] = left @ weights
                out[rows[own]] = np.column_stack([best[own], np.full(len(own), shift), coefficients[own]])
        return _filled({**{name: out[:, k] for k, name in enumerate(FIT)}, "areas": areas}, there)

    return measure, windows


def left_shoulder_metric(
    df: DataFrame, reference: DataFrame, *, q_min: float, q_max: float, points: int = 1800,
    shifts: Sequence[float] = (0.0,), half: float = BETA_HALF, min_order: int = MIN_ORDER,
    with_details: bool = True, fits_only: bool = False,
) -> DataFrame:
    """Net positive residual left of the alpha peaks: beta windows minus right control windows.

    One pass over ``df``, nothing is shuffled. The reference curve is computed first; it has a number for each grid point.
    A profile without finite point, or a reference that fits nowhere, leaves null results.
    """
    curve = curve_values(reference_curve(reference, q_min, q_max, points), points)
    measure, windows = fit_to_reference(curve, q_min=q_min, q_max=q_max, shifts=shifts, half=half, min_order=min_order)
    keys = [] if fits_only else ["session_uid", "data_batch", "started_on", "file_name"]
    found = df.select("vec_id", *keys, measure("q_range", "radial_profile_data").alias("_m"))
    if fits_only:
        return found.where("_m is not null").select("vec_id", *[f"_m.{n}" for n in FIT])
    k = len(windows)
    side = lambda first: P.total(F.slice("_m.areas", first + 1, k))
    width = 2.0 * half * max(1, k)
    found = found.withColumns({"kbeta_left_positive_area": side(0), "right_control_positive_area": side(k)})
    if with_details:
        fixed = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(a).alias("alpha_q"), F.lit(b).alias("beta_q"), F.lit(c).alias("right_control_q")) for o, a, b, c in windows])
        detail = F.transform(fixed, lambda w, i: F.struct(
            w["ord"].alias("ord"), *[w[n].alias(n) for n in ("alpha_q", "beta_q", "right_control_q")],
            F.get("_m.areas", i).alias("left_area"), F.get("_m.areas", i + k).alias("right_control_area"),
        ))
        found = found.withColumn("peak_windows", F.when(F.col("_m").isNotNull(), detail)).withColumn("peak_window_details", F.to_json("peak_windows"))
    net = F.greatest(F.col("kbeta_left_positive_area") - F.col("right_control_positive_area"), F.lit(0.0))
    given = F.col("_m").isNotNull()
    return found.withColumns(
        {
            "kbeta_left_net_area": F.when(given, net), "kbeta_left_mean_net_residual": F.when(given, net / width),
            "n_kbeta_windows": F.when(given, F.lit(k)), "window_orders": F.when(given, F.lit(",".join(str(w[0]) for w in windows))),
            **{n: F.col(f"_m.{n}") for n in FIT},
        }
    ).drop("_m")


def pass_fail(df: DataFrame, score: str = "kbeta_left_mean_net_residual", max_score: float = MAX_SCORE) -> DataFrame:
    """Own rule: accepted when the score is finite and at most ``max_score``."""
    ok = F.coalesce(X.finite(score) & (F.col(score) <= max_score), F.lit(False))
    return df.withColumns(
        {
            "agbh_monochromaticity_score": F.col(score), "agbh_monochromaticity_pass": ok,
            "agbh_monochromaticity_status": F.when(ok, "accepted").otherwise("rejected"),
        }
    )


def score_summary(df: DataFrame, *, key: str = "data_batch", score: str = "score", ok: str = "pass") -> DataFrame:
    """Count, accepted, rejected, min, median, mean, max per batch; rows without a batch form a group.

    A batch may hold most rows, so its median comes from the bucketed order statistics.
    """
    # NaN scores are counted, but are no values.
    named = df.withColumn("_k", F.coalesce(F.col(key), F.lit("\u0000"))).withColumn(score, F.when(~F.isnan(score), F.col(score)))
    basic = named.groupBy("_k").agg(
        F.max(key).alias(key), F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("accepted"),
        F.count_if(~F.col(ok)).alias("rejected"), F.min(score).alias("score_min"),
        F.avg(score).alias("score_mean"), F.max(score).alias("score_max"),
    )
    middle = ordered.quantiles(named, score, {"score_median": 0.5}, ["_k"])
    return basic.join(middle, "_k", "left").select(
        key, "n", "accepted", "rejected", "score_min", "score_median", "score_mean", "score_max"
    )


def selection_lists(df: DataFrame, ok: str = "pass") -> DataFrame:
    """(list, value) rows of accepted and rejected ids and days, one row per distinct value."""
    tag = F.when(F.col(ok), "accepted").otherwise("rejected")
    values = F.array(
        F.struct(F.concat(tag, F.lit("_session_uids")).alias("list"), F.col("session_uid").alias("value")),
        F.struct(F.concat(tag, F.lit("_dates")).alias("list"), F.to_date("started_at").cast("string").alias("value")),
    )
    return df.select(F.inline(values)).where("value is not null").distinct()


def list_checksum(values: DataFrame) -> Column:
    """Checksum of a column ``value`` as a set of texts, whatever the order of rows: the sum of 60 bits of every text's md5."""
    return F.coalesce(F.sum(F.conv(F.substring(F.md5("value"), 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")


LISTS = ("accepted_dates", "accepted_session_uids", "rejected_dates", "rejected_session_uids")


def selection_record(df: DataFrame, *, parameters: dict[str, float], ok: str = "pass") -> DataFrame:
    """One nested record: counts, parameters, and for every list its number of values and checksum.

    The filters name the list that holds their values; the lists themselves are the rows of ``selection_lists``.
    """
    n = df.agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(ok).alias("rows_accepted"),
        F.count_if(~F.col(ok)).alias("rows_rejected"),
    )
    sums = selection_lists(df, ok).groupBy("list").agg(F.count(F.lit(1)).alias("n"), list_checksum(df).alias("checksum"))
    each = [F.max(F.when(F.col("list") == name, F.struct("n", "checksum"))).alias(name) for name in LISTS]
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit("0").alias("checksum"))
    lists = sums.agg(*each).select(F.struct(*[F.coalesce(name, none).alias(name) for name in LISTS]).alias("lists"))  # one row
    return n.join(F.broadcast(lists)).select(
        F.lit(SELECTION_VERSION).alias("schema_version"),
        F.struct(*[F.lit(v).alias(k) for k, v in parameters.items()]).alias("parameters"),
        F.struct("rows_total", "rows_accepted", "rows_rejected").alias("selection"), "lists",
        F.struct(F.lit("started_at").alias("column"), F.lit("date in").alias("op"), F.lit("accepted_dates").alias("list")).alias("h5_date_filter"),
        F.struct(F.lit("linked_agbh_session_uid").alias("column"), F.lit("in").alias("op"), F.lit("accepted_session_uids").alias("list")).alias("h5_id_filter"),
    )


SELECTION_VERSION = "calibration_selection_v0_1"


def write_selection(df: DataFrame, path: str, *, parameters: dict[str, float], ok: str = "pass") -> str:
    """The record as JSON beside the lists it names, a folder for each list."""
    selection_lists(df, ok).write.mode("errorifexists").partitionBy("list").parquet(f"{path}/lists")
    return storage.write_json(selection_record(df, parameters=parameters, ok=ok), f"{path}/record")


def read_selection(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """Record and lists of a selection; a list whose count or checksum differs from the record is refused."""
    record = spark.read.json(f"{path}/record").first().asDict(True)
    if record["schema_version"] != SELECTION_VERSION:
        raise ValueError(f"selection schema {record['schema_version']} is not {SELECTION_VERSION}")
    rows = spark.read.schema("value string, list string").parquet(f"{path}/lists")
    found = {r["list"]: (r["n"], r["checksum"]) for r in rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), list_checksum(rows).alias("checksum")).collect()}
    for name in LISTS:
        told = record["lists"][name]
        if found.get(name, (0, "0")) != (told["n"], told["checksum"]):
            raise ValueError(f"list {name} does not match its record")
    return record, {name: rows.where(F.col("list") == name).select("value") for name in LISTS}


def exclude_rejected(rows: DataFrame, path: str, **columns: str) -> DataFrame:
    """Drop rows whose linked session was rejected; rows without a link fall back to the rejected days. The lists stay tables."""
    _, lists = read_selection(rows.sparkSession, path)
    return filters.exclude_sessions(rows, lists["rejected_session_uids"], lists["rejected_dates"], **columns)


def reference_band(df: DataFrame, good: Column, value: str) -> DataFrame:
    """Min, median and max of a metric over good calibrations, next to every row."""
    ok = df.where(good)
    # Two one-row tables.
    ends = ok.agg(F.min(value).alias("band_min"), F.max(value).alias("band_max"))
    middle = ordered.quantiles(ok, value, {"band_median": 0.5})
    return df.join(F.broadcast(ends)).join(F.broadcast(middle))
