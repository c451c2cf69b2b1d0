"""Row-local expressions over profile arrays.

All of them are built-in higher-order functions, so a profile never leaves its row: no explode,
no shuffle, no Python. Non-finite points are kept as NaN inside arrays and masked explicitly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .resampling import resample  # noqa: F401
from .scalars import col, finite

def let(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use`` as a lambda variable.

    The optimizer merges projections, and an expression that is captured inside a lambda would then be
    evaluated again for every array element. Binding it to a lambda variable keeps the cost linear.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def square_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def mean(a: Column) -> Column:
    return let(a, lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)))


def quantile(a: Column, p: float) -> Column:
    """Linear-interpolated quantile of an array without nulls; null when empty."""

    def pick(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(float(p))
        lo = F.floor(at).cast("int")
        a_lo, a_hi = F.get(s, lo), F.get(s, F.ceil(at).cast("int"))
        return F.when(F.size(s) > 0, a_lo + (a_hi - a_lo) * (at - lo))

    return let(F.array_sort(a), pick)


def median(a: Column) -> Column:
    return quantile(a, 0.5)


def in_window(q: Column, lo: float, hi: float) -> Column:
    return (q >= F.lit(float(lo))) & (q <= F.lit(float(hi)))


def roi_q(q: Column | str, lo: float, hi: float) -> Column:
    return F.filter(col(q), lambda x: in_window(x, lo, hi))


def roi_y(q: Column | str, y: Column | str, lo: float, hi: float) -> Column:
    """Values of y whose axis point lies in [lo, hi], both ends included."""
    return let(col(q), lambda axis: F.filter(col(y), lambda _, i: in_window(F.get(axis, i), lo, hi)))


def finite_y(q: Column | str, y: Column | str, lo: float, hi: float) -> Column:
    return let(
        col(q), lambda axis: F.filter(col(y), lambda v, i: in_window(F.get(axis, i), lo, hi) & finite(v))
    )


def peak_value(q: Column | str, y: Column | str, lo: float, hi: float) -> Column:
    """Largest finite value in the window; needs at least three finite points."""
    return let(finite_y(q, y, lo, hi), lambda w: F.when(F.size(w) >= 3, F.array_max(w)))


def nearest_point(q: Column | str, y: Column | str, target: float) -> Column:
    """struct(d, q, y) of the grid point closest to ``target`` (smaller q wins ties)."""
    return F.array_min(
        F.zip_with(
            col(q), col(y),
            lambda x, v: F.struct(F.abs(x - F.lit(float(target))).alias("d"), x.alias("q"), v.alias("y")),
        )
    )


def scale_by(y: Column | str, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(col(y), lambda v: v * f))


def divide_by(y: Column | str, denominator: Column) -> Column:
    return let(denominator, lambda d: F.transform(col(y), lambda v: v / d))


def min_max(y: Column | str) -> Column:
    """Subtract the minimum, then divide by the maximum when that is positive (finite input)."""

    def scaled(v: Column) -> Column:
        lo, hi = F.array_min(v), F.array_max(v)
        span = F.when(hi - lo > 0, hi - lo).otherwise(F.lit(1.0))
        return let(
            F.struct(lo.alias("lo"), span.alias("span")),
            lambda b: F.transform(v, lambda x: (x - b["lo"]) / b["span"]),
        )

    return let(col(y), scaled)


def trapezoid(q: Column | str, y: Column | str) -> Column:
    """Trapezoid integral of y over q; zero for fewer than two points."""

    def area(b: Column) -> Column:
        q_, y_ = b["q"], b["y"]
        steps = F.transform(
            F.slice(q_, 2, F.greatest(F.size(q_) - 1, F.lit(0))),
            lambda x, i: (x - F.get(q_, i)) * (F.get(y_, i) + F.get(y_, i + 1)) / 2.0,
        )
        return total(steps)

    return let(F.struct(col(q).alias("q"), col(y).alias("y")), area)


def positive_part(y: Column | str) -> Column:
    return F.transform(col(y), lambda v: F.greatest(v, F.lit(0.0)))


def _hat_matrix(window: int, order: int) -> np.ndarray:
    """Least-squares projection of ``window`` equally spaced points on polynomials of ``order``."""
    x = np.arange(window, dtype=float) - (window - 1) / 2.0
    basis = np.vander(x / max(1.0, (window - 1) / 2.0), order + 1)
    return basis @ np.linalg.pinv(basis)


def _weights(window: int) -> str:
    m = _hat_matrix(window, min(3, window - 2))
    return "array(" + ",".join("array(" + ",".join(f"{float(v)!r}D" for v in row) + ")" for row in m) + ")"


def smooth(y: str) -> Column:
    """Local cubic smoothing of the array column ``y`` over up to 11 points.

    Point i uses row ``i - s`` of the projection of the window starting at
    ``s = clip(i - half, 0, n - window)``: the centre row inside the profile, the polynomial of the
    end window at both ends. Profiles shorter than 7 points are returned unchanged.
    """

    def apply(w: int) -> str:
        start = f"least(greatest(i - {w // 2}, 0), size(v) - {w})"
        terms = f"zip_with(get({_weights(w)}, i - {start}), slice(v, {start} + 1, {w}), (a, b) -> a * b)"
        return f"transform(v, (x, i) -> aggregate({terms}, 0D, (s, t) -> s + t))"

    return F.expr(
        f"transform(array({y}), v -> case when size(v) < 7 then v when size(v) < 9 then {apply(7)} "
        f"when size(v) < 11 then {apply(9)} else {apply(11)} end)[0]"
    )


def interpolate(grid: Column, q: Column, y: Column) -> Column:
    """Piecewise-linear values of (q, y) on ``grid``, clamped at both ends; q ascending."""

    def lerp(b: Column) -> Column:
        q_, y_, n = b["q"], b["y"], F.size(b["q"])

        def at(x: Column) -> Column:
            below = F.size(F.filter(q_, lambda v: v <= x))
            lo = F.least(F.greatest(below - 1, F.lit(0)), F.greatest(n - 2, F.lit(0)))
            hi = F.least(lo + 1, n - 1)
            q0, q1, y0, y1 = F.get(q_, lo), F.get(q_, hi), F.get(y_, lo), F.get(y_, hi)
            return (
                F.when(x <= F.get(q_, F.lit(0)), F.get(y_, F.lit(0)))
                .when(x >= F.get(q_, n - 1), F.get(y_, n - 1))
                .otherwise(y0 + (y1 - y0) / (q1 - q0) * (x - q0))
            )

        return F.transform(grid, at)

    return let(F.struct(q.alias("q"), y.alias("y")), lerp)


def is_finite(x: str) -> str:
    """SQL text of the finite test."""
    return f"({x} is not null and not isnan({x}) and abs({x}) <> double('infinity'))"


def cosine_distance(a: str, b: str) -> Column:
    """1 - cosine over points finite in both array columns; null below 3 points or for a vanishing norm."""
    pairs = (
        f"filter(zip_with({a}, {b}, (x, y) -> named_struct('a', x, 'b', y)), "
        f"p -> {is_finite('p.a')} and {is_finite('p.b')})"
    )
    cos = "least(greatest(s.ab / (sqrt(s.aa) * sqrt(s.bb)), -1D), 1D)"
    return F.expr(
        f"aggregate({pairs}, named_struct('ab', 0D, 'aa', 0D, 'bb', 0D, 'n', 0), "
        "(s, p) -> named_struct('ab', s.ab + p.a * p.b, 'aa', s.aa + p.a * p.a, 'bb', s.bb + p.b * p.b, 'n', s.n + 1), "
        f"s -> case when s.n >= 3 and sqrt(s.aa) * sqrt(s.bb) > 1e-12 then 1D - {cos} end)"
    )
