"""Scalar column expressions: flags, sides, labels, text, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_flag(c: Column | str) -> Column:
    """Boolean coercion: null is false, only true/1/yes (any case) are true; double 1.0 is false."""
    return F.coalesce(F.lower(col(c).cast("string")).isin("true", "1", "yes"), F.lit(False))


def side_norm(c: Column | str) -> Column:
    """LEFT/RIGHT by prefix after trim and upper-case; anything else is null."""
    text = F.upper(F.trim(col(c).cast("string")))
    return F.when(text.startswith("LEFT"), "LEFT").when(text.startswith("RIGHT"), "RIGHT")


def side_display(norm: Column | str) -> Column:
    """Report spelling of a normalised side, empty text when unknown."""
    return F.when(col(norm) == "LEFT", "Left").when(col(norm) == "RIGHT", "Right").otherwise("")


def side_exact(c: Column | str) -> Column:
    """Scoring-side variant: only left/l and right/r are accepted."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.when(text.isin("left", "l"), "left").when(text.isin("right", "r"), "right")


def other_side(norm: Column | str) -> Column:
    return F.when(col(norm) == "LEFT", "RIGHT").when(col(norm) == "RIGHT", "LEFT")


def binary_label(group: Column | str) -> Column:
    """BENIGN -> 0, CANCER -> 1, otherwise null."""
    return F.when(col(group) == "BENIGN", 0).when(col(group) == "CANCER", 1).cast("int")


def label_name(label: Column | str) -> Column:
    return F.when(col(label) == 1, "CANCER").otherwise("BENIGN")


def non_blank(c: Column | str) -> Column:
    text = F.trim(col(c).cast("string"))
    return F.when(text != "", text)


def first_text(*cols: Column | str, default: str = "unknown") -> Column:
    """First non-blank value, else a placeholder."""
    return F.coalesce(*[non_blank(c) for c in cols], F.lit(default))


def finite(c: Column | str) -> Column:
    """True for a non-null number that is neither NaN nor infinite."""
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_or_zero(c: Column | str) -> Column:
    return F.when(finite(c), col(c)).otherwise(F.lit(0.0))


def finite_or_null(c: Column | str) -> Column:
    return F.when(finite(c), col(c))


def round_half_even(c: Column | str, digits: int) -> Column:
    """Rounding of the exact binary value, ties to even.

    The scaled value is rounded itself, so its error is computed exactly by splitting both factors into halves of
    26 bits: at an apparent tie its sign tells on which side the value lies.
    """
    x, scale = col(c), float(10**digits)
    half = lambda v: (v * 134217729.0) - ((v * 134217729.0) - v)
    sh = scale * 134217729.0 - (scale * 134217729.0 - scale)
    sl, xh = scale - sh, half(x)
    xl, p = x - xh, x * scale
    error = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    down = F.floor(p)
    tie = (p - down) == 0.5
    up = ((p - down) > 0.5) | (tie & ((error > 0) | ((error == 0) & (down % 2 != 0))))
    # Beyond 2^52 a double has no digits left to round.
    return F.when(F.abs(p) >= float(1 << 52), x).otherwise((down + up.cast("long")) / scale + F.lit(0.0))


def report_number(c: Column | str, digits: int = 5) -> Column:
    """Report rounding; non-finite becomes null."""
    return F.when(finite(c), round_half_even(c, digits))


def to_number(c: Column | str) -> Column:
    """Numeric coercion: text that is no number, and NaN, become null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def clip(c: Column | str, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def logit(p: Column | str) -> Column:
    x = clip(p, EPS, 1.0 - EPS)
    return F.ln(x / (F.lit(1.0) - x))


def expit(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when the denominator is zero."""
    return F.when(den != 0, num.cast("double") / den)
