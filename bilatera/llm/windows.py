"""Which windows of a fixed number of tokens occur more than once, without a row per window.

Every window has a mark: the smallest hash of the ``gram`` token runs inside it. Equal windows have equal
marks, and neighbouring windows mostly share one, so a document is a short list of stretches of windows with
one mark. Only stretches whose mark occurs again can hold repeated windows; all later work is on those. A stretch
that occurs again as a whole is settled by counting; the rest is compared window by window, in memory where a
mark has few distinct stretches, else by a further shuffle on the windows themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numeric as N

KEY = ("ka", "kb")
#: Distinct stretches of one mark that a task compares in memory; beyond it windows are shuffled.
IN_TASK = 2000


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Text with a 128-bit key of the row's content. Rows equal in id and text share it, and all they share."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more,
        F.xxhash64(F.lit(7), "doc_id", text).alias("ka"), F.xxhash64(text, F.lit(11), "doc_id").alias("kb"),
    )


ROW_KEY = ("__row_ka", "__row_kb")


def with_row_key(docs: DataFrame) -> DataFrame:
    """All columns and the key of ``keyed`` under names of their own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.withColumns(dict(zip(ROW_KEY, (F.xxhash64(F.lit(7), doc_id, text), F.xxhash64(text, F.lit(11), doc_id)))))


def under_row_key(found: DataFrame, *columns: str) -> DataFrame:
    return found.select(*[F.col(k).alias(r) for k, r in zip(KEY, ROW_KEY)], *columns)


def stretches(values: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Stretches of windows with one mark: mark, content hash, row, first window, windows, internal repeat."""
    ranges = N.Ranges(values)
    grams = ranges.grams(gram)
    least = N.sliding_min(grams, width - gram + 1)
    lengths = np.maximum(np.diff(offsets) - width + 1, 0)
    starts = N.spread(offsets[:-1], lengths)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return {"h": none.astype(N.U), "x": none.astype(N.U), "row": none, "s": none, "m": none, "twice": none.astype(bool)}
    row, mark = np.repeat(np.arange(len(lengths)), lengths), least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    # The mark's place leaves the window while its value stays: the same run of tokens comes again inside.
    again = np.zeros(len(starts), bool)
    again[1:] = ~new[1:] & (grams[starts[:-1]] == mark[:-1])
    at = starts[first]
    return {
        "h": mark[first], "x": ranges(at, at + count - 1 + width), "row": row[first], "s": at - offsets[row[first]],
        "m": count, "twice": np.add.reduceat(again.astype(np.int64), first) > 0,
    }


def only(got: dict[str, np.ndarray], known) -> dict[str, np.ndarray]:
    """Stretches whose mark may be in a filter; all without one."""
    if known is None:
        return got
    keep = known(got["h"])
    return {k: v[keep] for k, v in got.items()}


def table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def packed(text: DataFrame, keep: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda b: b) -> DataFrame:
    """The same rows, or those of each batch that ``keep`` returns, with the text compressed, for a shuffle of whole texts."""
    rest = [f for f in text.schema.fields if f.name != "text"]

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in map(keep, N.slices(batches, "text")):
            data, offsets = N.flat(b.column("text"))
            raw = data.tobytes()
            small = pa.array([press.compress(raw[lo:hi]) for lo, hi in zip(offsets[:-1], offsets[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), small], names=[*(f.name for f in rest), "packed"])

    return text.mapInArrow(squeeze, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", packed binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size with ``text`` in place of ``packed``."""
    press = zstandard.ZstdDecompressor()
    for b in N.slices(batches, "packed", 1 << 17):
        texts = pa.array([press.decompress(x).decode() for x in b.column("packed").to_pylist()], pa.string())
        names = [n for n in b.schema.names if n != "packed"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), texts], names=[*names, "text"])


class BitFilter:
    """A fixed number of bits that tells most values outside a set; a join on the set itself follows.

    The size grows with the set up to ``most`` bits. Beyond that it lets more through, nothing is lost.
    """

    def __init__(self, rows: DataFrame, column: str = "h", most: int = 1 << 26):
        size = min(most, 1 << max(10, (16 * rows.count()).bit_length()))
        self.mask = size - 1
        place = F.explode(F.array(F.col(column).bitwiseAND(F.lit(self.mask)), F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(self.mask))))
        bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
        got = rows.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
        bits = np.zeros(size >> 6, np.int64)
        bits[got.column("w").to_numpy()] = got.column("b").to_numpy()
        self.sent = rows.sparkSession.sparkContext.broadcast(bits)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        bits = self.sent.value.view(N.U)
        found = np.ones(len(h), bool)
        for place in (h & N.U(self.mask), (h >> N.U(32)) & N.U(self.mask)):
            found &= (bits[place >> N.U(6)] >> (place & N.U(63))) & N.U(1) > 0
        return found


def hot_or_not(groups: DataFrame, stretch_count: Column) -> tuple[DataFrame, DataFrame]:
    return groups.where(stretch_count <= IN_TASK), groups.where(stretch_count > IN_TASK)


def per_document(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
    """Fields of all stretches of a document in one array; as long as the document at most."""
    return rows.groupBy(*KEY).agg(F.collect_list(F.struct(*fields)).alias(name))


def by_groups(step: Callable[[pa.Table], Iterator[pa.RecordBatch]], keys: list[str], limit: int = 1 << 20):
    """Run ``step`` on whole groups of a partition sorted by ``keys``, about ``limit`` bytes at a time.

    Memory is bounded by ``limit`` and the largest group, whatever the size of the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                held.append(b.slice(at, 1024))
                size += held[-1].nbytes
                if size < limit:
                    continue
                rows = pa.Table.from_batches(held).combine_chunks()
                last = np.all([rows.column(k).to_numpy() == rows.column(k)[-1].as_py() for k in keys], axis=0)
                cut = rows.num_rows - int(last.sum())
                if cut:
                    yield from step(rows.slice(0, cut).combine_chunks())
                    rows = rows.slice(cut).combine_chunks()
                held = rows.to_batches()
                size = rows.nbytes if cut else 0  # a group that goes on grows by another limit before the next try
        if held:
            yield from step(pa.Table.from_batches(held).combine_chunks())
        pa.default_memory_pool().release_unused()

    return run
