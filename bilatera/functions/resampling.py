"""Profiles of an Arrow batch brought to one grid, all rows of an axis at a time.

Interpolation on a fixed grid is linear in the profile: every grid point is a weighted sum of two neighbours, and neighbours
and weights depend on the axis alone. Rows of a batch are grouped by their axis and by which points are finite; each group
takes one set of indices and weights and one vectorised gather.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Rows that are placed on a grid together.
BLOCK = 512


def lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, first index and length of each list; a null list has length -1, a null value is NaN."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = a.offsets.to_numpy()
    values = pc.fill_null(a.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    valid = a.is_valid().to_numpy(zero_copy_only=False)
    return values, offsets[:-1].astype(np.int64), np.where(valid, np.diff(offsets), -1)


def axis_weights(axis: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, t): the value on the grid is y[left] + (y[right] - y[left]) * t, clamped at both ends; axis ascending."""
    right = np.clip(np.searchsorted(axis, grid, side="right"), 1, max(len(axis) - 1, 1))
    right = np.minimum(right, len(axis) - 1)
    left = np.maximum(right - 1, 0)
    step = axis[right] - axis[left]
    t = np.divide(grid - axis[left], step, out=np.zeros(len(grid)), where=step > 0)
    return left, right, np.clip(t, 0.0, 1.0)


def _groups(q: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each row and a row of each group: equal axis, equal finite points."""
    key = np.concatenate([np.ascontiguousarray(q).view(np.uint8), np.packbits(ok, axis=1)], axis=1)
    rows = np.ascontiguousarray(key).view(np.dtype((np.void, key.shape[1]))).ravel()
    _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
    return inverse, first


def on_grid(q: pa.Array, y: pa.Array, grid: np.ndarray, *, scaled: bool = False, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (row numbers, values on the grid). Rows that are null, of unequal lengths or without finite point are left out.

    With ``scaled`` the values of a row are brought to [0, 1]; a constant row becomes zero.
    """
    qv, qs, qn = lists(q)
    yv, ys, yn = lists(y)
    length = np.where(qn == yn, qn, -1)
    for n in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == n)
        for at in range(0, len(rows), block):
            part = rows[at : at + block]
            axes, values = qv[qs[part][:, None] + np.arange(n)], yv[ys[part][:, None] + np.arange(n)]
            ok = np.isfinite(axes) & np.isfinite(values)
            inverse, first = _groups(axes, ok)
            for g, r in enumerate(first):
                good = ok[r]
                if not good.any():
                    continue
                members = np.flatnonzero(inverse == g)
                left, right, t = axis_weights(axes[r][good], grid)
                have = values[members][:, good]
                out = have[:, left]
                out = out + (have[:, right] - out) * t
                if scaled:
                    out -= out.min(axis=1, keepdims=True)
                    top = out.max(axis=1, keepdims=True)
                    out /= np.where(top > 0, top, 1.0)
                yield part[members], out


def resample(lo: float, hi: float, points: int, *, scaled: bool = False):
    """Arrow function placing each profile on ``linspace(lo, hi, points)``, finite points only; null where there is none."""
    grid = np.linspace(float(lo), float(hi), int(points))

    @F.arrow_udf("array<double>")
    def place(q: pa.Array, y: pa.Array) -> pa.Array:
        out, there = np.zeros((len(q), len(grid))), np.zeros(len(q), bool)
        for rows, values in on_grid(q, y, grid, scaled=scaled):
            out[rows], there[rows] = values, True
        ends = np.concatenate([[0], np.cumsum(np.where(there, len(grid), 0))])
        offsets = pa.array(ends.astype(np.int32), mask=np.append(~there, False))
        return pa.ListArray.from_arrays(offsets, pa.array(out[there].ravel()))

    return place
