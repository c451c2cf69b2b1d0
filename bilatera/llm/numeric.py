"""Vectorised text primitives: every function works on one Arrow batch inside a task.

Hashes are polynomials over 64-bit integers (sum of value[i] * base^i, modulo 2^64). The base is odd, so a
range hash is a difference of prefix sums times a power of the inverse base, for all ranges at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.empty(size, U)
        have[0], done = 1, 1
        while done < size:
            factor = np.full(1, pow(base, done, 1 << 64), U)
            have[done : 2 * done] = have[:done] * factor
            done *= 2
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


class Ranges:
    """Hashes of any ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        self.inverse = pow(base, -1, 1 << 64)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * powers(base, n), out=self.sums[1:])

    def __call__(self, start, end) -> np.ndarray:
        inverse = powers(self.inverse, len(self.sums))[start]
        return mix((self.sums[end] - self.sums[start]) * inverse)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` values from every position that has so many."""
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * powers(self.inverse, m)) if m > 0 else np.zeros(0, U)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours: block-wise running minima from both sides."""
    k = len(x) - w + 1
    if k <= 0:
        return x[:0]
    padded = np.full((-(-len(x) // w) + 1) * w, np.iinfo(U).max, U)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:k], ahead[w - 1 : w - 1 + k])


def flat(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text or binary column; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = array.type
    array = array.fill_null(b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "")
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 18, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text (and ``rows`` rows), or one row where a row is longer."""
    for batch in batches:
        _, offsets = flat(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), n, at + (rows or n))
            yield batch.slice(at, end - at)
            at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the word offsets of each row. Words never cross rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= edge[1:-1] | ~inside[:-1]
    last[:-1] &= edge[1:-1] | ~inside[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owners(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def byte_values(data: np.ndarray) -> np.ndarray:
    return data.astype(U) + U(1)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    return Ranges(byte_values(data), base)(starts, ends) ^ mix((ends - starts).astype(U))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in any of the ranges."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth)[:n] > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start, concatenated."""
    total = int(counts.sum())
    jumps = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if total else np.zeros(0, np.int64)
    return jumps + np.arange(total)
