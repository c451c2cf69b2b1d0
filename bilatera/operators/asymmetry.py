"""Paired features of a target side against the opposite side.

Plan: per-row array expressions (slice, smooth, put on the common axis), one grouped aggregate per
(patient, side) over fixed-size blocks of grid points, then row-local array expressions per case.
Blocks keep the shuffle near the size of the profiles, aggregate before it, and spread a patient
with very many rows; no side's rows are ever collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import scalars as X
from .. import schemas as S
from . import signal

BLOCK = 8
y_name = "radial_profile_data"


@dataclass(frozen=True)
class Contract:
    """Regions and rules of a feature contract."""

    roi: tuple[float, float] = (6.7, 23.0)
    full: tuple[float, float] = (2.0, 23.0)
    mask1: tuple[float, float] = (6.7, 15.0)
    mask2: tuple[float, float] = (15.0, 23.0)
    legacy: bool = False


CURRENT = Contract()
LEGACY = Contract(roi=(7.5, 23.0), mask1=(7.0, 15.0), legacy=True)


def _slice(q: Column, y: Column, roi: tuple[float, float], contract: Contract) -> tuple[Column, Column]:
    qs, ys = P.roi_q(q, *roi), P.roi_y(q, y, *roi)
    if contract.legacy:
        short = F.size(qs) < 5
        return F.when(short, q).otherwise(qs), F.when(short, y).otherwise(ys)
    return qs, ys


def _common_axes(rows: DataFrame, per_patient: bool) -> DataFrame:
    """Attach the axis of the patient's first usable row (smallest id) for both regions.

    With one shared axis, as delivered by fixed-range integration, each row's own axis is used.
    """
    if not per_patient:
        return rows.withColumns({"qc1": F.col("q1"), "qcf": F.col("qf")})
    first = lambda q: F.min_by(F.col(q), F.when(F.col(q).isNotNull(), F.col("measurement_id")))
    axes = rows.groupBy("patientId").agg(first("q1").alias("qc1"), first("qf").alias("qcf"))
    return rows.join(axes, "patientId")


def _on_axis(axis: str, q: str, y: str) -> Column:
    a, b, v = F.col(axis), F.col(q), F.col(y)
    return F.when(a == b, v).otherwise(P.interpolate(a, b, v))


def side_profiles(df: DataFrame, contract: Contract = CURRENT, *, shared_axis: bool = False) -> DataFrame:
    """Per (patient, side): counts, mean and spread profiles, raw mean, sum of unit vectors, mean peak."""
    q, y = F.col("q_range"), F.col("radial_profile_data")
    rows = df.select(
        "patientId", X.side_norm("side").alias("side_norm"), "measurement_id", q, y
    ).where("side_norm is not null")
    q1, y1 = _slice(q, y, contract.roi, contract)
    qf, yf = _slice(q, y, contract.full, contract)
    rows = rows.withColumns({"_q1": q1, "_y1": y1, "_qf": qf, "_yf": yf})
    rows = rows.selectExpr(
        "*", *[f"case when size(_q{k}) >= 5 then _{v}{k} end as {n}{k}" for k in "1f" for v, n in (("q", "q"), ("y", "u"))]
    )
    s1, sf = P.smooth("u1"), P.smooth("uf")
    if contract.legacy:
        s1, sf = (signal.near_minimum_normalise(F.col(a), v) for a, v in (("q1", s1), ("qf", sf)))
    whole = f"not exists({y_name}, v -> not {P.is_finite('v')}) and size({y_name}) >= 3"
    norm = f"sqrt(aggregate({y_name}, 0D, (s, v) -> s + v * v))"
    rows = rows.withColumns(
        {
            "s1": s1, "sf": sf, "_peak": P.peak_value(q, y, 13.0, 14.8),
            "_norm": F.expr(f"case when {whole} and {norm} > 1e-6 then {norm} end"),
        }
    )
    rows = _common_axes(rows, per_patient=not shared_axis)
    placed = {"a1": F.col("s1"), "af": F.col("sf")}
    if not shared_axis:
        placed = {"a1": _on_axis("qc1", "q1", "s1"), "af": _on_axis("qcf", "qf", "sf")}
    rows = rows.withColumns(
        {**placed, "unit": F.when(F.col("_norm").isNotNull(), P.divide_by(y, F.col("_norm")))}
    )
    return _aggregate_blocks(rows)


def _aggregate_blocks(rows: DataFrame) -> DataFrame:
    """Sum up arrays point by point: blocks of points are exploded, aggregated and put together again."""
    sources = {"qc1": "qc1", "qcf": "qcf", "a1": "a1", "af": "af", "raw": y_name, "unit": "unit"}
    longest = "greatest(" + ",".join(f"coalesce(size({c}), 0)" for c in sources.values()) + ")"
    cuts = ",".join(f"'{n}',slice({c}, b * {BLOCK} + 1, {BLOCK})" for n, c in sources.items())
    pieces = rows.selectExpr(
        "patientId", "side_norm", "_peak", "_norm is not null as _unit_ok",
        f"explode(transform(sequence(0, greatest(cast(ceil({longest} / {BLOCK}) as int) - 1, 0)), "
        f"b -> named_struct('b', b, {cuts}))) as z",
    )
    span = range(BLOCK)
    each = lambda text, name: F.expr("array(" + ",".join(text.format(k=k) for k in span) + ")").alias(name)
    parts = pieces.groupBy("patientId", "side_norm", F.col("z.b").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_unit_ok").alias("n_unit"),
        F.avg(X.finite_or_null("_peak")).alias("peak"),
        each("max(get(z.qc1, {k}))", "q1"), each("max(get(z.qcf, {k}))", "qf"), each("avg(get(z.a1, {k}))", "mu"),
        # A single replicate has no spread: 0 where the mean exists.
        each("coalesce(stddev_samp(get(z.a1, {k})), avg(get(z.a1, {k})) * 0D)", "sd"),
        each("avg(get(z.af, {k}))", "muf"), each("avg(get(z.raw, {k}))", "raw"), each("sum(get(z.unit, {k}))", "unit"),
    )
    names = ("q1", "qf", "mu", "sd", "muf", "raw", "unit")
    out = parts.groupBy("patientId", "side_norm").agg(
        F.max("n").alias("n"), F.max("n_unit").alias("n_unit"), F.max("peak").alias("peak"),
        F.array_sort(F.collect_list(F.struct("b", *names))).alias("_l"),
    )
    return out.selectExpr(
        "patientId", "side_norm", "n", "n_unit", "peak",
        *[f"filter(flatten(transform(_l, s -> s.{n})), v -> v is not null) as {n}" for n in names],
    )


def within_cosine(unit_sum: str, n: str) -> Column:
    """Mean pairwise cosine distance inside a side without forming pairs.

    For unit vectors u the sum over i<j of u_i.u_j equals (|sum u|^2 - n) / 2.
    """
    square = f"aggregate({unit_sum}, 0D, (s, v) -> s + v * v)"
    return F.expr(f"case when {n} >= 2 then 1D - ({square} - {n}) / ({n} * ({n} - 1D)) end")


def _points() -> Column:
    """struct(q, d, v, st, sc) per grid point: mean difference, summed variance, both spreads."""
    return F.expr(
        "transform(array(named_struct('q', q1_t, 'mt', mu_t, 'mc', mu_c, 'st', sd_t, 'sc', sd_c)), z -> "
        "transform(z.q, (x, i) -> named_struct('q', x, 'd', get(z.mt, i) - get(z.mc, i), "
        "'v', get(z.st, i) * get(z.st, i) + get(z.sc, i) * get(z.sc, i), 'st', get(z.st, i), 'sc', get(z.sc, i))))[0]"
    )


def _mask_features(points: str, mask: tuple[float, float], k: str) -> Column:
    """struct of the five features of one mask; each needs five finite points."""

    def rms(field: str) -> str:
        good = f"filter(p, s -> {P.is_finite('s.' + field)})"
        total = f"aggregate(g, 0D, (t, s) -> t + s.{field} * s.{field})"
        return f"transform(array({good}), g -> case when size(g) >= 5 then sqrt({total} / size(g)) end)[0]"

    good = f"filter(p, s -> {P.is_finite('s.d')} and {P.is_finite('s.v')})"
    # 5th percentile of the variances, linear between neighbours.
    floor = (
        "transform(array(array_sort(transform(g, s -> s.v))), o -> transform(array((size(o) - 1) * 0.05D), "
        "h -> get(o, int(floor(h))) + (get(o, int(ceil(h))) - get(o, int(floor(h)))) * (h - floor(h)))[0])[0] + 1e-12D"
    )
    weighted = (
        "aggregate(g, named_struct('n', 0D, 'd', 0D), (t, s) -> named_struct("
        "'n', t.n + s.d * s.d / greatest(s.v, f), 'd', t.d + 1D / greatest(s.v, f)), t -> sqrt(t.n / t.d))"
    )
    wrms = f"transform(array({good}), g -> case when size(g) >= 5 then transform(array({floor}), f -> {weighted})[0] end)[0]"
    distance = (
        f"transform(array({good}), g -> case when size(g) >= 5 then "
        "sqrt(aggregate(g, 0D, (t, s) -> t + s.d * s.d / (s.v + 1e-12D))) end)[0]"
    )
    fields = {
        "meanrms": rms("d"), "weightedrms": wrms, "sigma_target": rms("st"), "sigma_contralateral": rms("sc"),
        "mahalanobis": distance,
    }
    made = ",".join(f"'sk_{n}{k}',{t}" for n, t in fields.items())
    inside = f"filter({points}, s -> s.q >= {mask[0]!r}D and s.q <= {mask[1]!r}D)"
    return F.expr(f"transform(array({inside}), p -> named_struct({made}))[0]")


def wasserstein(q: str, a: str, b: str) -> Column:
    """Area between the two cumulative curves; null below 5 points or when a side has no mass."""
    good = (
        f"filter(transform({q}, (x, i) -> named_struct('q', x, 'a', get({a}, i), 'b', get({b}, i))), "
        f"s -> {P.is_finite('s.q')} and {P.is_finite('s.a')} and {P.is_finite('s.b')})"
    )
    points = f"array_sort(transform({good}, s -> named_struct('q', s.q, 'a', greatest(s.a, 0D), 'b', greatest(s.b, 0D))))"
    mass = (
        "aggregate(p, named_struct('a', 0D, 'b', 0D), (t, s) -> named_struct('a', t.a + s.a, 'b', t.b + s.b))"
    )
    area = (
        "aggregate(p, named_struct('area', 0D, 'gap', 0D, 'q', get(p, 0).q), (t, s) -> named_struct("
        "'area', t.area + abs(t.gap) * (s.q - t.q), 'gap', t.gap + s.a / m.a - s.b / m.b, 'q', s.q), t -> t.area)"
    )
    return F.expr(
        f"transform(array({points}), p -> transform(array({mass}), m -> "
        f"case when size(p) >= 5 and m.a > 1e-12 and m.b > 1e-12 then {area} end)[0])[0]"
    )


def pair_features(
    cases: DataFrame, sides: DataFrame, contract: Contract = CURRENT
) -> DataFrame:
    """All paired columns per case: gate, reason, counts, cosine scores and the feature vector.

    ``cases`` needs target_case_id, patientId, target_side_norm, contralateral_side_norm.
    """
    pick = lambda side, tag: sides.select(
        "patientId", F.col("side_norm").alias(side),
        *[F.col(c).alias(f"{c}_{tag}") for c in sides.columns if c not in ("patientId", "side_norm")],
    )
    z = (
        cases.select("target_case_id", "patientId", "target_side_norm", "contralateral_side_norm")
        .join(pick("target_side_norm", "t"), ["patientId", "target_side_norm"], "left")
        .join(pick("contralateral_side_norm", "c"), ["patientId", "contralateral_side_norm"], "left")
    )
    made = "coalesce(size(mu_t) > 0 and size(mu_c) > 0 and size(muf_t) > 0 and size(muf_c) > 0, false)"
    z = z.withColumns(
        {
            "target_measurements": F.expr("coalesce(n_t, 0L)"),
            "contralateral_measurements": F.expr("coalesce(n_c, 0L)"),
            "_both": F.expr(made),
            "_wt": within_cosine("unit_t", "n_unit_t"),
            "_wc": within_cosine("unit_c", "n_unit_c"),
            "_between": P.cosine_distance("raw_t", "raw_c"),
            "_points": _points(),
            "_d14": F.abs(P.peak_value("q1_t", "mu_t", 13.5, 14.5) - P.peak_value("q1_t", "mu_c", 13.5, 14.5)),
            "_w1": wasserstein("q1_t", "mu_t", "mu_c"),
            "_wf": wasserstein("qf_t", "muf_t", "muf_c"),
            "_cf": P.cosine_distance("muf_t", "muf_c"),
        }
    )
    masks = {"1": contract.mask1, "2": contract.mask2}
    z = z.withColumns({f"_m{k}": _mask_features("_points", m, k) for k, m in masks.items()})
    raw = {
        f"sk_{name}{k}": f"_m{k}.sk_{name}{k}" for k in masks
        for name in ("meanrms", "weightedrms", "sigma_target", "sigma_contralateral", "mahalanobis")
    }
    raw["sk_peak14_intensity_abs_delta"] = "_d14"
    raw["sk_mean_peak_value_abs_delta"] = "abs(peak_t - peak_c)"
    raw["sk_wasserstein_distance_mu_tc"] = "_w1"
    raw["sk_cosine_distance_full_q2"] = "_cf"
    raw["sk_wasserstein_distance_full_q2"] = "_wf"
    z = z.selectExpr("*", *[f"case when _both then {raw[n]} end as _raw_{n}" for n in S.PAIR_FEATURES])

    broken = " or ".join(f"not {P.is_finite('_raw_' + c)}" for c in S.CORE4)
    reason = "case when contralateral_measurements = 0 then 'contralateral_breast_unavailable'"
    if not contract.legacy:
        reason += " when target_measurements < 2 or contralateral_measurements < 2"
        reason += f" then 'fewer_than_2_valid_measurements_per_breast' when {broken} then 'sk_core4_not_computable'"
    z = z.withColumn("symmetry_reason", F.expr(reason + " else '' end"))
    paired = "symmetry_reason in ('', 'sk_core4_not_computable')"
    within = "coalesce((_wt + _wc) / 2D, _wt, _wc, 0D)"
    value = lambda ok, v, name: f"case when {ok} and {P.is_finite(v)} then {v} else 0D end as {name}"
    return z.selectExpr(
        "target_case_id", "cast(symmetry_reason = '' as int) as symmetry_available",
        "symmetry_reason", "target_measurements", "contralateral_measurements",
        value("true", "_wt", "target_within_cosine_distance_mean"),
        value("true", "_wc", "contralateral_within_cosine_distance_mean"),
        value(paired, "_between", "between_breasts_cosine_distance_mean"),
        value(paired, f"(_between - {within})", "symmetry_cosine_score"),
        *[value("symmetry_reason = ''", f"_raw_{n}", n) for n in S.PAIR_FEATURES],
    )
