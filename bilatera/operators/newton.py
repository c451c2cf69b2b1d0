"""Penalised two-parameter logistic fits of many keys at once, over rows that are packed and kept for all passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ("loss", "g0", "g1", "h00", "h01", "h11")
MOVES, SETTLED, FLAT = 0, 1, 2


class State:
    """Points of all keys as arrays, the last accepted points with their losses, and how each key stands."""

    def __init__(self, keys: int):
        self.a, self.b = np.zeros(keys), np.ones(keys)
        self.status = np.full(keys, MOVES)
        self.back = np.full((3, keys), np.nan)

    def advance(self, s: np.ndarray, c: float) -> None:
        """One Newton update of every moving key from its six sums (keys x 6).

        A step that raised the loss is halved. Without curvature there is no finite optimum.
        """
        live = np.flatnonzero(self.status == MOVES)
        a, b = self.a[live], self.b[live]
        loss, g0, g1, h00, h01, h11 = s[live].T
        loss, g1, h11 = loss + b**2 / (2 * c), g1 + b / c, h11 + 1.0 / c
        back = self.back[:, live]
        worse = loss > back[2] + 1e-12 * (1 + np.abs(back[2]))  # never without a last point
        det = h00 * h11 - h01**2
        flat = ~worse & (det <= 1e-14 * h00 * h11)
        step = ~worse & ~flat
        with np.errstate(divide="ignore", invalid="ignore"):
            da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            done = step & (g0 * da + g1 * db <= 1e-14 * (1 + np.abs(loss)))
        self.status[live[flat]] = FLAT
        self.status[live[done]] = SETTLED
        self.back[:, live[step]] = np.stack([a, b, loss])[:, step]
        self.a[live] = np.where(worse, (a + back[0]) / 2, np.where(step, a - da, a))
        self.b[live] = np.where(worse, (b + back[1]) / 2, np.where(step, b - db, b))


Pass = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray]


def solve(packed: DataFrame, keys: int, sums: Pass, one_class: np.ndarray, *, c: float, iterations: int) -> State:
    """Fit all keys. A pass reads the packed rows once; tasks add the sums of all keys, Spark adds the tasks' sums.

    ``sums`` gives keys x 6 sums of one batch at the points (a, b). Only keys x 6 numbers reach the driver. A key that does not
    settle fails the job.
    """
    state = State(keys)
    state.status[one_class] = FLAT
    for _ in range(iterations):
        live = state.status == MOVES
        if not live.any():
            return state

        def run(batches: Iterator[pa.RecordBatch], a=state.a, b=state.b, live=live) -> Iterator[pa.RecordBatch]:
            total = np.zeros((keys, len(SUMS)))
            for batch in batches:
                total += sums(batch, a, b)
            at = np.flatnonzero(live & total.any(axis=1))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[at, i]) for i in range(len(SUMS))]], names=["k", *SUMS])

        added = packed.mapInArrow(run, "k long, " + ", ".join(f"{n} double" for n in SUMS)).groupBy("k").agg(*[F.sum(n).alias(n) for n in SUMS])
        got = added.toArrow()
        found = np.zeros((keys, len(SUMS)))
        found[got.column("k").to_numpy()] = np.column_stack([got.column(n).to_numpy() for n in SUMS])
        state.advance(found, c)
    if open_ := np.flatnonzero(state.status == MOVES).tolist():
        raise ValueError(f"calibration does not settle within {iterations} passes for {len(open_)} keys, first {open_[0]}")
    return state


def terms(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted loss, residual and curvature of each element, without overflow."""
    e = np.exp(-np.abs(z))
    m = np.where(z >= 0, 1.0, e) / (1.0 + e)
    return w * (np.maximum(z, 0.0) + np.log1p(e) - y * z), w * (m - y), w * m * (1.0 - m)


ROWS = "k binary, x binary, y binary, w binary"


def pack_rows(df: DataFrame) -> DataFrame:
    """Rows (k int, x, y, w double) as blocks of binary arrays; equal (k, x, y) of a batch are one weighted row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, x, y, w = (b.column(n).to_numpy(zero_copy_only=False) for n in ("k", "x", "y", "w"))
            sort = np.lexsort((y, x, k))
            k, x, y, w = k[sort], x[sort], y[sort], w[sort]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            first = np.flatnonzero(new)
            if len(first):
                cells = [k[first].astype(np.int32), x[first], y[first], np.add.reduceat(w, first)]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in cells], names=["k", "x", "y", "w"])

    return df.mapInArrow(run, ROWS)


def row_sums(keys: int) -> Pass:
    def sums(batch: pa.RecordBatch, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros((keys, len(SUMS)))
        for cells in zip(*[batch.column(n).to_pylist() for n in ("k", "x", "y", "w")]):
            k = np.frombuffer(cells[0], np.int32)
            x, y, w = (np.frombuffer(v, np.float64) for v in cells[1:])
            loss, r, v = terms(a[k] + b[k] * x, y, w)
            for i, value in enumerate((loss, r, r * x, v, v * x, v * x * x)):
                total[:, i] += np.bincount(k, value, keys)
        return total

    return sums
