"""Global and keyed order statistics that never sort one group in one task.

A cumulative sum over a whole table is usually a window with one partition. Here rows are first reduced to one per distinct value.
A range shuffle puts these in order over as many partitions as the data need; every partition sums its own in one stream, and the
partitions' totals, a row for each partition and key, give the offsets. A key may fill many partitions or a partition hold many
keys. Ties and hot values vanish in the first step.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row's key differs from the row before; the first row's answer is of no meaning."""
    out = np.zeros(len(columns[0]) if columns else 0, bool)
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _stream(by: Sequence[str], names: Sequence[str]):
    """Running sums of sorted batches, restarted with every key: ``_cum`` and ``_next`` of each sum, the partition, and its last row of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carry, held = {n: 0 for n in names}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            rows = table.to_batches()[0]
            # The first row was held back: its sum is in the carry already.
            done = 0 if held is None else 1
            new = _changes([rows.column(k) for k in by]) if by else np.zeros(rows.num_rows, bool)
            cells, cums = {}, {}
            starts = np.flatnonzero(new)
            for n in names:
                v = rows.column(n).to_numpy(zero_copy_only=False)
                before = np.concatenate([np.zeros(1, v.dtype), np.cumsum(v[:-1])])
                base = np.zeros(len(v), v.dtype)
                base[:] = (v[0] - carry[n]) if done else -carry[n]
                for lo, hi in zip(starts, np.append(starts[1:], len(v))):
                    base[lo:hi] = before[lo]
                cums[n] = before + v - base
                follow = np.append(v[1:], v[-1:])
                cells[n] = follow, np.append(new[1:], True)
                carry[n] = cums[n][-1]
            held = rows.slice(rows.num_rows - 1)
            if rows.num_rows > 1:
                yield _out(rows.slice(0, rows.num_rows - 1), {n: c[:-1] for n, c in cums.items()}, {n: (f[:-1], m[:-1]) for n, (f, m) in cells.items()}, part)
            last = {n: c[-1:] for n, c in cums.items()}
        if held is not None:
            yield _out(held, last, {n: (c, np.ones(1, bool)) for n, c in last.items()}, part)

    def _out(rows, cums, follow, part):
        columns = {f: rows.column(f) for f in rows.schema.names}
        for n in names:
            columns[f"{n}_cum"] = pa.array(cums[n])
            columns[f"{n}_next"] = pa.array(follow[n][0], mask=follow[n][1])
        columns["_last"] = pa.array(follow[names[0]][1])
        columns["_part"] = pa.array(np.full(rows.num_rows, part, np.int32))
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def running_totals(
    df: DataFrame, value: str, sums: Mapping[str, Column], by: Sequence[str] = (), *, descending: bool = False, partitions: int | None = None,
) -> DataFrame:
    """One row per (by, distinct value) with, for every sum ``s``:

    ``s`` the own amount, ``s_cum`` the inclusive running total, ``s_all`` the key's total,
    ``s_next`` the own amount of the next value in order (null at the end).

    Partitions follow the session's setting where ``partitions`` is not given. The ordered rows are written to the shared folder, so
    offsets and rows come from the same partitions whatever is computed again.
    """
    by, names = list(by), list(sums)
    grouped = df.groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    order = [*[F.asc(k) for k in by], F.desc(value) if descending else F.asc(value)]
    dealt = grouped.repartitionByRange(partitions, *order) if partitions else grouped.repartitionByRange(*order)
    kinds = {f.name: f.dataType.simpleString() for f in grouped.schema.fields}
    schema = ", ".join([f"`{k}` {t}" for k, t in kinds.items()] + [f"`{n}_cum` {kinds[n]}, `{n}_next` {kinds[n]}" for n in names])
    placed = cut_lineage(dealt.sortWithinPartitions(*order).mapInArrow(_stream(by, names), schema + ", _last boolean, _part int"))
    own = F.struct(*names)
    ends = placed.groupBy(*by, "_part").agg(
        *[F.sum(n).alias(f"_{n}") for n in names],
        (F.max_by(own, value) if descending else F.min_by(own, value)).alias("_first"),
    )
    # A row for each partition that holds some of a key.
    over = Window.partitionBy(*by).orderBy("_part")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(
        *by, "_part",
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_before") for n in names],
        *[F.sum(f"_{n}").over(Window.partitionBy(*by)).alias(f"{n}_all") for n in names],
        F.lead("_first").over(over).alias("_follow"),
    )
    return placed.join(offsets, [*by, "_part"]).select(
        *by, value, *names,
        *[(F.col(f"{n}_cum") + F.col(f"_{n}_before")).alias(f"{n}_cum") for n in names],
        *[F.col(f"{n}_all") for n in names],
        *[F.when(F.col("_last"), F.col(f"_follow.{n}")).otherwise(F.col(f"{n}_next")).alias(f"{n}_next") for n in names],
    )


def quantiles(
    df: DataFrame, value: str, points: Mapping[str, float], by: Sequence[str] = (), *, partitions: int | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, null and NaN left out; the groups may be of any size."""
    by = list(by)
    curve = running_totals(
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))), value, {"n": F.lit(1)}, by, partitions=partitions
    )
    picks = []
    for name, p in points.items():
        at = (F.col("n_all") - 1) * F.lit(float(p))
        lo, hi = F.floor(at), F.ceil(at)
        a = F.min(F.when(F.col("n_cum") > lo, F.col(value)))
        b = F.min(F.when(F.col("n_cum") > hi, F.col(value)))
        picks.append((a + (b - a) * (F.max(at) - F.max(lo))).alias(name))
    return curve.groupBy(*by).agg(*picks)


def dense_index(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "ix") -> DataFrame:
    """0-based position of each row in ``order`` within ``by``; rows equal in both are interchangeable.

    Rows are numbered within the partitions of a range shuffle, whose counts give the offsets. They are written to the shared folder with
    their numbers, so both come from the same partitions.
    """
    by = list(by)
    keys = {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    keys["_read"] = F.monotonically_increasing_id()  # deals out rows that are equal otherwise
    dealt = df.withColumns(keys).repartitionByRange(*by, *keys).sortWithinPartitions(*by, *keys).drop(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(dealt.withColumns({"_part": F.spark_partition_id(), "_at": at}))
    counts = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    return placed.join(starts, [*by, "_part"]).withColumn(name, F.col("_at") + F.col("_start")).drop("_part", "_at", "_start")


def first_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key. Spark prunes each map task to k rows per key before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
