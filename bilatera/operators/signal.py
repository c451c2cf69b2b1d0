"""Detector binning, corrections, normalisation and profile gates.

The steps whose formulas are not published carry a definition of our own, named in each docstring.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import resampling as R
from ..functions import scalars as X
from .. import schemas as S


def geometry(df: DataFrame, text: str = "ponifile") -> DataFrame:
    """Geometry text to typed columns and the largest reachable q in nm^-1.

    Own definition: unrotated detector; the largest radius is the farthest corner from the beam centre,
    q = 4 pi / lambda * sin(atan(r / d) / 2), lambda in nm.
    """
    keys = {
        "distance_m": "Distance", "poni1_m": "Poni1", "poni2_m": "Poni2", "pixel1_m": "PixelSize1",
        "pixel2_m": "PixelSize2", "wavelength_m": "Wavelength", "rows": "Rows", "cols": "Columns",
    }
    m = F.str_to_map(F.col(text), F.lit("\n"), F.lit(":"))
    num = lambda m, k: F.trim(F.element_at(m, k)).try_cast("double")
    far = lambda centre, size: F.greatest(centre, size - centre)

    def reach(g: Column) -> Column:
        r = F.sqrt(
            F.pow(far(g["poni1_m"], g["rows"] * g["pixel1_m"]), 2.0)
            + F.pow(far(g["poni2_m"], g["cols"] * g["pixel2_m"]), 2.0)
        )
        return q_of_radius(r, g["distance_m"], g["wavelength_m"] * 1e9)

    # Bound once: a filter on the result would otherwise parse the text anew for every number in the formula.
    numbers = P.let(m, lambda m: F.struct(*[num(m, k).alias(c) for c, k in keys.items()]))
    return df.withColumns({**{c: num(m, k) for c, k in keys.items()}, "poni_q_max": P.let(numbers, reach)})


def q_of_radius(radius: Column, distance: Column, wavelength_nm: Column) -> Column:
    return F.lit(4.0 * math.pi) / wavelength_nm * F.sin(F.atan(radius / distance) / 2.0)


def faulty_pixels(
    df: DataFrame, *, counts: str = "counts", radius: str = "radius",
    bright_min: float = S.BRIGHT_PIXEL_MIN, beam_radius: float = S.BEAM_RADIUS,
) -> DataFrame:
    """Own definition: a pixel is faulty at or above the bright limit, outside the beam-centre radius."""
    return df.withColumn("faulty", (F.col(counts) >= bright_min) & (F.col(radius) > beam_radius))


def q_bin(q: Column, lo: float, hi: float, points: int) -> Column:
    """Bin number in [0, points); null outside the half-open range [lo, hi)."""
    at = F.floor((q - F.lit(lo)) / F.lit(hi - lo) * points).cast("int")
    return F.when((q >= lo) & (q < hi), at)


def bin_centre(b: Column, lo: float, hi: float, points: int) -> Column:
    return F.lit(lo) + (b.cast("double") + 0.5) * F.lit((hi - lo) / points)


def azimuthal_bins(
    df: DataFrame, *, lo: float = S.Q_RANGE[0], hi: float = S.Q_RANGE[1], points: int = S.GRID_POINTS,
    mask: str | None = "faulty",
) -> DataFrame:
    """Mean intensity and Poisson error per (measurement, bin); masked pixels are skipped.

    Own definition: no pixel splitting; sigma = sqrt(sum of counts) / n. The partial aggregate keeps
    at most ``points`` rows per measurement and task, so large frames shrink before the shuffle.
    """
    px = df.withColumn("bin", q_bin(F.col("q"), lo, hi, points)).where("bin is not null")
    if mask:
        px = px.where(~F.col(mask))
    return px.groupBy("measurement_id", "bin").agg(
        F.avg("counts").alias("intensity"),
        (F.sqrt(F.sum("counts")) / F.count(F.lit(1))).alias("sigma"),
        F.count(F.lit(1)).alias("pixels"),
    )


def profiles_from_bins(
    bins: DataFrame, *, lo: float = S.Q_RANGE[0], hi: float = S.Q_RANGE[1], points: int = S.GRID_POINTS
) -> DataFrame:
    """One row per measurement with arrays ordered by q; each list holds at most ``points`` bins."""
    rows = F.array_sort(
        F.collect_list(F.struct("bin", F.col("intensity").alias("y"), F.col("sigma").alias("s")))
    )
    out = bins.groupBy("measurement_id").agg(rows.alias("_b"))
    return out.select(
        "measurement_id",
        F.transform("_b", lambda b: bin_centre(b["bin"], lo, hi, points)).alias("q_range"),
        F.transform("_b", lambda b: b["y"]).alias("radial_profile_data"),
        F.transform("_b", lambda b: b["s"]).alias("sigma"),
    )


def thickness_correct(
    df: DataFrame, *, sample: str = "sample_thickness_mm", reference: str = "calibrant_thickness_mm"
) -> DataFrame:
    """Own definition: multiply profile and error by reference / sample thickness; null when missing."""
    f = F.when(F.col(sample) > 0, F.col(reference) / F.col(sample))
    out = df.withColumns({"thickness_factor": f, "thickness_adjusted": f.isNotNull()})
    out = out.withColumn("radial_profile_data", P.scale_by("radial_profile_data", F.col("thickness_factor")))
    if "sigma" in df.columns:
        out = out.withColumn("sigma", P.scale_by("sigma", F.col("thickness_factor")))
    return out


def snr_db(y: Column | str, sigma: Column | str) -> Column:
    """Own definition: 20 log10(mean(I) / mean(sigma)); null unless both means are positive."""
    means = F.struct(P.mean(X.col(y)).alias("a"), P.mean(X.col(sigma)).alias("s"))
    return P.let(
        means, lambda m: F.when((m["a"] > 0) & (m["s"] > 0), F.lit(20.0) * F.log10(m["a"] / m["s"]))
    )


def snr_filter(df: DataFrame, min_db: float = S.MIN_SNR_DB) -> DataFrame:
    return df.where(F.col("snr_db") >= min_db)


def band_normalise(
    df: DataFrame, lo: float = S.NORM_BAND[0], hi: float = S.NORM_BAND[1], *, keep_raw: bool = False
) -> DataFrame:
    """Divide a profile by its median inside [lo, hi], so that this median becomes 1.

    Rows without a finite, non-zero band median get a null profile.
    """
    band = P.median(P.finite_y("q_range", "radial_profile_data", lo, hi))
    out = df.withColumn("_band", band)
    if keep_raw:
        out = out.withColumn("radial_profile_data_raw", F.col("radial_profile_data"))
    good = F.when(F.col("_band") != 0, F.col("_band"))
    return out.withColumn("radial_profile_data", P.divide_by("radial_profile_data", good)).drop("_band")


def profile_gate(df: DataFrame, *, q: float = S.GATE_Q, threshold: float = S.GATE_MIN) -> DataFrame:
    """Value at the grid point nearest to q, its position and offset, and whether it exceeds the limit."""
    out = df.withColumn("_n", P.nearest_point("q_range", "radial_profile_data", q))
    return out.withColumns(
        {
            "radial_profile_value_at_q": F.col("_n.y"),
            "radial_profile_nearest_q_nm_inv": F.col("_n.q"),
            "radial_profile_q_delta_nm_inv": F.col("_n.d"),
            "radial_profile_value_pass": F.coalesce(X.finite("_n.y") & (F.col("_n.y") > threshold), F.lit(False)),
        }
    ).drop("_n")


def profile_check(df: DataFrame, column: str = "radial_profile_data") -> DataFrame:
    """One row: distinct profile lengths and rows holding a null or non-finite point."""
    bad = F.exists(F.col(column), lambda v: ~X.finite(v))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.size(column)).alias("min_points"),
        F.max(F.size(column)).alias("max_points"),
        F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_rows"),
    )


def require_profiles(df: DataFrame, column: str = "radial_profile_data") -> DataFrame:
    """Fail unless all profiles are finite and of one length."""
    r = profile_check(df, column).first()
    if r["min_points"] != r["max_points"]:
        raise ValueError(f"profiles in {column!r} must have equal length")
    if r["bad_rows"]:
        raise ValueError(f"profiles in {column!r} contain non-finite values")
    return df


def near_minimum_normalise(q: Column, y: Column, q0: float = 6.7, half: float = 0.25) -> Column:
    """Older normalisation: divide by the 5th percentile near q0, else of the whole profile, else by 1."""

    def scaled(v: Column) -> Column:
        near = P.finite_y(q, v, q0 - half, q0 + half)
        every = F.filter(v, lambda x: X.finite(x))
        base = P.let(
            near, lambda n: F.when(F.size(n) >= 2, P.quantile(n, 0.05)).otherwise(P.quantile(every, 0.05))
        )
        base = P.let(base, lambda b: F.when(X.finite(b) & (F.abs(b) >= 1e-12), b).otherwise(F.lit(1.0)))
        return P.divide_by(v, base)

    return P.let(y, scaled)


def peak_height(df: DataFrame, centre: float, window: float) -> DataFrame:
    """Peak above the median of the side bands (of the whole profile when the bands are empty)."""

    def sides(axis: Column) -> Column:
        left = lambda x: (x >= centre - 3 * window) & (x < centre - 1.5 * window)
        right = lambda x: (x > centre + 1.5 * window) & (x <= centre + 3 * window)
        return F.filter(
            F.col("radial_profile_data"),
            lambda v, i: X.finite(v) & (left(F.get(axis, i)) | right(F.get(axis, i))),
        )

    def height(b: Column) -> Column:
        whole = F.filter(F.col("radial_profile_data"), lambda v: X.finite(v))
        base = F.when(F.size(b["side"]) > 0, P.median(b["side"])).otherwise(P.median(whole))
        return F.when(F.size(b["peak"]) > 0, F.array_max(b["peak"]) - base)

    peak = P.finite_y("q_range", "radial_profile_data", centre - window, centre + window)
    both = F.struct(P.let(F.col("q_range"), sides).alias("side"), peak.alias("peak"))
    return df.withColumn("peak_height", P.let(both, height))


def heat_map(df: DataFrame, lo: float, hi: float, points: int) -> DataFrame:
    """Profiles on one grid, divided by their maximum when positive; one (row, grid index, value) each."""
    out = df.withColumn("_y", R.resample(lo, hi, points)("q_range", "radial_profile_data"))
    top = F.array_max("_y")
    return out.withColumn("heat", P.divide_by("_y", F.when(top > 0, top).otherwise(F.lit(1.0)))).drop("_y")
