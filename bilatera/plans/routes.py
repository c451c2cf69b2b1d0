"""Preprocessing routes: one ordered step list with two parameter sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..operators import filters, signal
from ..operators.filters import Predicate
from .. import schemas as S
from ..sources import reference
from ..sources.storage import cut_lineage


@dataclass(frozen=True)
class Step:
    """A named function with parameters and a switch.

    ``table`` says what it works on: the measurement rows, the pixel table, or both, which gives rows. The step that
    starts the pixel table brings it as ``source``.
    """

    name: str
    fn: Callable[..., DataFrame]
    params: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    table: str = "rows"
    source: DataFrame | None = None


def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Fold the enabled steps into one lazy plan, in the given order; integration of pixels writes the rows before it once."""
    names = [s.name for s in steps]
    if len(set(names)) != len(names):
        raise ValueError("step names must be unique")
    pixels = None
    for step in steps:
        if not step.enabled:
            continue
        if step.table == "pixels":
            pixels = (pixels if step.source is None else step.source).transform(step.fn, **step.params)
        elif step.table == "both":
            df = step.fn(df, pixels, **step.params)
        else:
            df = df.transform(step.fn, **step.params)
    return df


@dataclass(frozen=True)
class Policy:
    """Switches and limits of a route. ``has_geometry``: rows carry a geometry text."""

    date_from: str | None = None
    excluded_ids: tuple[str, ...] = ()
    excluded_dates: tuple[str, ...] = ()
    biopsy_rows: bool = False
    biopsy_patient: bool = False
    status_keep: tuple[str, ...] = ()
    group_keep: tuple[str, ...] = ()
    pair_keep: tuple[tuple[str, str], ...] = ()
    normal_as_benign: bool = True
    has_sigma: bool = False
    has_geometry: bool = False
    has_pixels: bool = False
    band: tuple[float, float] = S.NORM_BAND
    gate: float = S.GATE_MIN
    min_snr_db: float = S.MIN_SNR_DB
    min_measurements: int = 1
    min_specimens: int = 1
    columns: tuple[str, ...] = S.TRAINING_COLUMNS
    column_errors: str = "raise"


def training_policy(**changes) -> Policy:
    """Label, biopsy and exclusion filters; the listed sessions and days are excluded unless changed."""
    base = dict(
        excluded_ids=reference.EXCLUDED_SESSIONS, excluded_dates=reference.EXCLUDED_DATES,
        biopsy_patient=True, status_keep=S.STATUS_KEEP, group_keep=S.GROUP_KEEP, columns=S.TRAINING_COLUMNS,
    )
    return Policy(**{**base, **changes})


def prediction_policy(**changes) -> Policy:
    """Technical quality control only: no date, label, biopsy or exclusion filter."""
    base = dict(normal_as_benign=False, columns=S.PREDICTION_COLUMNS, column_errors="ignore")
    return Policy(**{**base, **changes})


def _where(df: DataFrame, rules: Sequence[Predicate]) -> DataFrame:
    return filters.where_all(df, rules)


def _group(df: DataFrame) -> DataFrame:
    return filters.keep_groups_with(df, "patientId", F.coalesce(F.col("biopsy"), F.lit(False)))


def _gate(df: DataFrame, threshold: float) -> DataFrame:
    return signal.profile_gate(df, threshold=threshold).where("radial_profile_value_pass")


def _geometry(df: DataFrame) -> DataFrame:
    """Typed geometry from its text; the detector's reach in q is what later filters look at."""
    return signal.geometry(df).withColumn("poni_q_max_nm_inv", F.col("poni_q_max"))


def _integrate(df: DataFrame, pixels: DataFrame, points: int) -> DataFrame:
    """Profiles of the surviving rows from their unmasked pixels, corrected for thickness; frames of dropped rows are never binned.

    The rows are written first. In one plan Spark would carry filters that follow from ``measurement_id``, such as those on the
    geometry text, over to the pixels and evaluate them for every pixel.
    """
    df = cut_lineage(df)
    px = pixels.join(df.select("measurement_id").distinct(), "measurement_id", "left_semi")
    profiles = signal.profiles_from_bins(signal.azimuthal_bins(px, points=points), points=points)
    return signal.thickness_correct(df.drop("q_range", "radial_profile_data").join(profiles, "measurement_id"))


def _snr(df: DataFrame) -> DataFrame:
    return df.withColumn("snr_db", signal.snr_db("radial_profile_data", "sigma"))


def _q_window(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """Keep the constant q range of the profiles."""
    q, y = P.roi_q("q_range", lo, hi), P.roi_y("q_range", "radial_profile_data", lo, hi)
    return df.withColumns({"q_range": q, "radial_profile_data": y})


def build_steps(p: Policy, *, pixels: DataFrame | None = None, points: int = S.GRID_POINTS) -> list[Step]:
    """All 21 steps in contract order; a step without its input data is switched off.

    With a pixel table, faulty pixels are marked there and integration replaces the profiles of the rows.
    """

    rule = lambda *r: {"rules": list(r)}
    px = pixels is not None
    sessions = [
        Predicate("started_on", "date>=", value=p.date_from, enabled=p.date_from is not None),
        Predicate("biopsy", "==", value=True, enabled=p.biopsy_rows),
        Predicate("specimen_status", "in", values=p.status_keep, enabled=bool(p.status_keep)),
        Predicate("calibrant_thickness_mm", "notna"),
        Predicate("poni_q_max_nm_inv", ">=", value=S.REQUIRED_Q_MAX),
    ]

    def select_sessions(df: DataFrame) -> DataFrame:
        out = filters.where_all(df, sessions)
        if p.excluded_ids or p.excluded_dates:
            out = filters.exclude_sessions(out, p.excluded_ids, p.excluded_dates)
        return out

    return [
        Step("poni_geometry", _geometry, enabled=p.has_geometry),
        Step("select_h5_sessions", select_sessions),
        Step("h5_to_df", _where, rule(Predicate("sample_thickness_mm", "notna"), Predicate("position", "in", values=S.POSITIONS))),
        Step("product_columns", filters.label_columns, {"normal_as_benign": p.normal_as_benign}),
        Step("position_filter", _where, rule(Predicate("position", "in", values=S.POSITIONS))),
        Step("sample_thickness_filter", _where, rule(Predicate("sample_thickness_mm", ">", value=0.0))),
        Step("calibrant_thickness_filter", _where, rule(Predicate("calibrant_thickness_mm", "between", lower=S.CALIBRANT_MM[0], upper=S.CALIBRANT_MM[1]))),
        Step("biopsy_filter", _where, rule(Predicate("biopsy", "==", value=True)), p.biopsy_rows),
        Step("patient_biopsy_filter", _group, enabled=p.biopsy_patient),
        Step("specimen_status_filter", _where, rule(Predicate("specimen_status", "in", values=p.status_keep)), bool(p.status_keep)),
        Step("product_status_filter", _where, rule(Predicate("product_status_group", "in", values=p.group_keep)), bool(p.group_keep)),
        Step("paired_patient_filter", filters.keep_label_pairs, {"allowed": p.pair_keep}, bool(p.pair_keep)),
        Step("faulty_pixels", signal.faulty_pixels, enabled=px, table="pixels", source=pixels),
        Step("interpolation_q_range", _q_window, {"lo": S.Q_RANGE[0], "hi": S.Q_RANGE[1]}, not px),
        Step("azimuthal_integration", _integrate, {"points": points}, px, "both"),
        Step("snr", _snr, enabled=px or p.has_sigma),
        Step("snr_filter", signal.snr_filter, {"min_db": p.min_snr_db}, px or p.has_sigma),
        Step("specimen_validity", filters.specimen_validity, {"min_measurements": p.min_measurements, "min_specimens": p.min_specimens}),
        Step("normalization", signal.band_normalise, {"lo": p.band[0], "hi": p.band[1]}),
        Step("profile_gate", _gate, {"threshold": p.gate}),
        Step("keep_columns", filters.keep_columns, {"columns": p.columns, "errors": p.column_errors}),
    ]


def per_profile(df: DataFrame, fn, name: str, returns: str = "double") -> DataFrame:
    """User hook over profiles: ``fn`` maps two Series of arrays (q, y) to a Series, as an Arrow batch."""
    return df.withColumn(name, F.pandas_udf(fn, returns)("q_range", "radial_profile_data"))


def per_case(
    df: DataFrame, partial, finish, state: str, schema: str, keys: Sequence[str] = ("patientId", "side")
) -> DataFrame:
    """User hook over all rows of a case, as an aggregate.

    ``partial`` maps some rows of one case to rows of a state (keys included), ``finish`` all state rows of a case
    to the result. A task reduces its own rows first, so a case of any size reaches ``finish`` as one state per batch.
    """
    names = list(keys)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield from (partial(part) for _, part in rows.groupby(names, dropna=False, sort=False))

    return df.mapInPandas(reduce, state).groupBy(*names).applyInPandas(finish, schema)
