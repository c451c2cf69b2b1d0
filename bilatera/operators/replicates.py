"""Bootstrap replicates as packed counts: how often each patient was drawn, one number for each replicate in one row.

A case is joined to its patient's counts once. Sums over cases are products of counts with case values, all replicates together.
Rank metrics need scores in order: a range shuffle cuts the distinct scores into blocks, blocks add up their classes for every replicate,
a running sum over blocks says what lies above each, and a second pass finishes a block from there. What is shuffled has a row for
each case and a row for each block and replicate, never one for each case and replicate. Equal scores stay in one block, and equal scores
of a task are added up before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.storage import cut_lineage
from . import newton, ordered

#: Distinct scores of a block, about; blocks are read in chunks of ``CHUNK`` rows.
BLOCK, CHUNK = 1 << 16, 256
#: Patients whose counts are added up in one array; draws that a task makes at once.
PATIENTS, DRAWS = 1024, 1 << 21


def encode(counts: np.ndarray) -> list[bytes]:
    """Rows of counts, each in the narrowest whole numbers that hold it."""
    top = counts.max(axis=1, initial=0)
    kinds = [next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if t <= np.iinfo(k).max) for t in top.tolist()]
    return [row.astype(k).tobytes() for row, k in zip(counts, kinds)]


def decode(rows: pa.Array, replicates: int) -> np.ndarray:
    """The counts as a matrix, one row for each binary value; the width of a value tells its numbers' size."""
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}
    if len(rows) and pa.types.is_binary(rows.type):
        at = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
        if (np.diff(at) == replicates).all():  # all of one byte
            return np.frombuffer(rows.buffers()[2], np.uint8, len(rows) * replicates, at[0]).reshape(len(rows), replicates).astype(np.int64)
    out = np.empty((len(rows), replicates), np.int64)
    for i, b in enumerate(rows.to_pylist()):
        out[i] = np.frombuffer(b, kinds[len(b) // replicates])
    return out


def indexed(patients: DataFrame) -> DataFrame:
    """(patientId, ix): patients in order of their md5."""
    ids = patients.select("patientId").distinct().withColumn("_h", F.md5("patientId"))
    return ordered.dense_index(ids, ["_h", "patientId"]).drop("_h")


def draw(seed: int, b: Column, slot: Column, n: Column) -> Column:
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), b.cast("string"), slot.cast("string")))
    return F.conv(F.substring(text, 1, 12), 16, 10).cast("long") % n


def packed_counts(patients: DataFrame, *, replicates: int, seed: int, with_whole: bool = False) -> DataFrame:
    """(patientId, counts): draws of every patient by replicate; patients that no replicate draws have no row.

    A replicate draws as many patients as there are, with replacement; every patient row supplies one draw slot per
    replicate. Draws travel as lists of four-byte numbers, one list for ``PATIENTS`` patients and batch of slots. With
    ``with_whole`` a further replicate stands before them that draws everyone once.
    """
    known = cut_lineage(indexed(patients))
    total = known.agg(F.count(F.lit(1)).alias("_n"))  # one row
    width = replicates + with_whole
    # A row is ``replicates`` draws: tasks go by their number, not by the few bytes that they read.
    tasks = int(patients.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prefixes = [f"{seed}:{b}:".encode() for b in range(replicates)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, DRAWS // width)
            for at in range(0, batch.num_rows, step):
                ix, n = (batch.column(c).to_numpy()[at : at + step] for c in ("ix", "_n"))
                slots = [str(i).encode() for i in ix.tolist()]
                who, code = [], []
                for b, prefix in enumerate(prefixes, start=int(with_whole)):
                    drawn = _numbers([hashlib.md5(prefix + s).digest() for s in slots]) % n
                    who.append(drawn // PATIENTS)
                    code.append(drawn % PATIENTS * width + b)
                if with_whole:
                    who.append(ix // PATIENTS)
                    code.append(ix % PATIENTS * width)
                who, code = np.concatenate(who), np.concatenate(code).astype(np.uint32)
                order = np.argsort(who, kind="stable")
                who, code = who[order], code[order]
                first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                codes = [c.tobytes() for c in np.split(code, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(who[first]), pa.array(codes, pa.binary())], names=["part", "codes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = None, None

        def rows() -> pa.RecordBatch:
            table = counts.reshape(PATIENTS, width)
            ix = np.flatnonzero(table.any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array(ix + part * PATIENTS), pa.array(encode(table[ix]), pa.binary())], names=["ix", "counts"])

        for batch in batches:
            for number, codes in zip(batch.column("part").to_pylist(), batch.column("codes").to_pylist()):
                if number != part:
                    if part is not None:
                        yield rows()
                    part, counts = number, np.zeros(PATIENTS * width, np.int64)
                np.add.at(counts, np.frombuffer(codes, np.uint32), 1)
        if part is not None:
            yield rows()

    drawn = known.select("ix").repartition(tasks).join(F.broadcast(total)).mapInArrow(deal, "part long, codes binary")
    packed = drawn.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(pack, "ix long, counts binary")
    return packed.join(known, "ix").select("patientId", "counts")


def _numbers(digests: list[bytes]) -> np.ndarray:
    """The first 48 bits of every digest, as ``draw`` takes them."""
    head = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)[:, :6].astype(np.int64)
    return head @ (1 << np.arange(40, -1, -8, dtype=np.int64))


def _by_replicate(total: np.ndarray, names: list[str], **more: int) -> pa.RecordBatch:
    """One row for each replicate from a matrix names x replicates."""
    cells = {**{n: np.full(total.shape[1], v, np.int32) for n, v in more.items()}, "b": np.arange(total.shape[1], dtype=np.int32), **dict(zip(names, total))}
    return pa.RecordBatch.from_arrays([pa.array(v) for v in cells.values()], names=list(cells))


def weighted_sums(rows: DataFrame, names: list[str], replicates: int) -> DataFrame:
    """(b, sums): every column of ``names`` times the counts, added up; a task gives one row for each replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), replicates))
        seen = False
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part, seen = b.slice(at, CHUNK), True
                values = np.stack([part.column(n).to_numpy(zero_copy_only=False) for n in names])
                total += values @ decode(part.column("counts"), replicates)
        if seen:
            yield _by_replicate(total, names)

    out = rows.select(*[F.col(n).cast("double").alias(n) for n in names], "counts").mapInArrow(run, "b int, " + ", ".join(f"{n} double" for n in names))
    return out.groupBy("b").agg(*[F.sum(n).alias(n) for n in names])


def _ties(p: np.ndarray) -> np.ndarray:
    """First row of every run of equal scores."""
    return np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, np.int64)


def _merged(p: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal score and label added up, in descending order of score."""
    sort = np.lexsort((y, -p))
    p, y, counts = p[sort], y[sort], counts[sort]
    first = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (y[1:] != y[:-1])))
    return p[first], y[first], np.add.reduceat(counts, first, axis=0)


def score_blocks(cases: DataFrame, replicates: int, block: int = BLOCK) -> DataFrame:
    """(block, p, y, counts): the cases in blocks of descending scores, equal ones of a task added up."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # One pass over the batch in score order; a chunk ends with a run of equal scores, which is added up as it grows.
            p, y = (b.column(n).to_numpy(zero_copy_only=False) for n in ("p", "y"))
            order = np.argsort(-p, kind="stable")
            held = None
            for at in range(0, len(order), CHUNK):
                take = order[at : at + CHUNK]
                rows = (p[take], y[take], decode(b.column("counts").take(pa.array(take)), replicates))
                if held is not None:
                    rows = tuple(np.concatenate([a, c]) for a, c in zip(held, rows))
                rows = _merged(*rows)
                last = rows[0] == rows[0][-1] if at + CHUNK < len(order) else np.zeros(len(rows[0]), bool)
                held = tuple(a[last] for a in rows)
                if not last.all():
                    yield _rows(*[a[~last] for a in rows])

    def _rows(p, y, counts):
        return pa.RecordBatch.from_arrays([pa.array(p), pa.array(y), pa.array(encode(counts), pa.binary())], names=["p", "y", "counts"])

    merged = cases.select(F.col("p").cast("double").alias("p"), F.col("y").cast("int").alias("y"), "counts").mapInArrow(merge, "p double, y int, counts binary")
    blocks = max(1, -(-cases.count() // block))
    dealt = merged.repartitionByRange(blocks, F.desc("p"))
    return cut_lineage(dealt.select(F.spark_partition_id().alias("block"), "p", "y", "counts"))


def rank_sums(cases: DataFrame, replicates: int, block: int = BLOCK) -> DataFrame:
    """(b, positives, negatives, area, precision): rank sums of every replicate over cases with p, y and counts; ties are halved."""
    rows = score_blocks(cases, replicates, block)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = None, np.zeros((2, replicates), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                of, y = part.column("block").to_numpy(), part.column("y").to_numpy()
                counts = decode(part.column("counts"), replicates)
                for k in np.unique(of):
                    if number is not None and k != number:
                        yield _by_replicate(total, ["pos", "neg"], block=number)
                        total = np.zeros((2, replicates), np.int64)
                    number, own = int(k), of == k
                    total += np.stack([counts[own & (y == 1)].sum(axis=0), counts[own & (y != 1)].sum(axis=0)])
        if number is not None:
            yield _by_replicate(total, ["pos", "neg"], block=number)

    per = rows.select("block", "y", "counts").mapInArrow(classes, "block int, b int, pos long, neg long").groupBy("block", "b").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    per = cut_lineage(per)
    upto = Window.partitionBy("b").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = per.select("block", "b", (F.sum("pos").over(upto) - F.col("pos")).alias("tp"), (F.sum("neg").over(upto) - F.col("neg")).alias("fp"))
    # A block's row of offsets: two numbers for each replicate; it comes before the block's scores.
    offsets = before.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("b", "tp", "fp"))).alias("o")).select(
        "block", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("int").alias("y"),
        F.lit(None).cast("binary").alias("counts"), F.col("o.tp").alias("tp"), F.col("o.fp").alias("fp"),
    )
    none = F.lit(None).cast("array<bigint>")
    stream = offsets.unionByName(rows.select("block", F.lit(1).alias("kind"), "p", "y", "counts", none.alias("tp"), none.alias("fp")))
    stream = stream.repartition("block").sortWithinPartitions("block", "kind", F.desc("p"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = total = held = None

        def add(p, y, counts):
            """Whole runs of equal scores."""
            first = _ties(p)
            pos = np.add.reduceat(counts * (y == 1)[:, None], first, axis=0)
            neg = np.add.reduceat(counts * (y != 1)[:, None], first, axis=0)
            tp, fp = above[0] + np.cumsum(pos, axis=0), above[1] + np.cumsum(neg, axis=0)
            total[0] += (neg * (tp - pos + pos / 2.0)).sum(axis=0)
            total[1] += np.divide(pos * tp, tp + fp, out=np.zeros(pos.shape), where=tp + fp > 0).sum(axis=0)
            above[0], above[1] = tp[-1], fp[-1]

        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                kind = part.column("kind").to_numpy()
                cuts = np.append(np.flatnonzero(kind == 0), len(kind))
                pieces = [(0, cuts[0])] + [(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:])]
                for lo, hi in pieces:
                    if lo < len(kind) and kind[lo] == 0:
                        if held is not None:
                            add(*held)
                        if total is not None:
                            yield _by_replicate(total, ["area", "precision"])
                        held, total = None, np.zeros((2, replicates))
                        above = [np.array(part.column(n)[int(lo)].as_py(), np.int64) for n in ("tp", "fp")]
                        lo += 1
                    if hi <= lo:
                        continue
                    rows = part.slice(lo, hi - lo)
                    got = (rows.column("p").to_numpy(zero_copy_only=False), rows.column("y").to_numpy(zero_copy_only=False), decode(rows.column("counts"), replicates))
                    if held is not None:
                        got = tuple(np.concatenate([a, c]) for a, c in zip(held, got))
                    last = got[0] == got[0][-1]
                    if not last.all():
                        add(*[a[~last] for a in got])
                    held = _merged(*[a[last] for a in got])
        if held is not None:
            add(*held)
        if total is not None:
            yield _by_replicate(total, ["area", "precision"])

    sums = stream.mapInArrow(finish, "b int, area double, precision double").groupBy("b").agg(F.sum("area").alias("area"), F.sum("precision").alias("precision"))
    whole = per.groupBy("b").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return whole.join(sums, "b")


def rank_metrics(cases: DataFrame, replicates: int, block: int = BLOCK) -> DataFrame:
    """(b, roc_auc, pr_auc); null where a class is missing."""
    pos, neg = F.col("positives"), F.col("negatives")
    return rank_sums(cases, replicates, block).select(
        "b", F.when((pos > 0) & (neg > 0), F.col("area") / (pos.cast("double") * neg)).alias("roc_auc"),
        F.when(pos > 0, F.col("precision") / pos).alias("pr_auc"),
    )


def calibration(cases: DataFrame, replicates: int, *, c: float = 1e6, iterations: int = 60) -> DataFrame:
    """(b, calibration_intercept, calibration_slope) over cases with p, y and counts; null where there is no finite fit.

    A pass reads every case once and forms the terms of all replicates from its logit and counts.
    """
    rows = cases.select(X.logit("p").alias("x"), F.col("y").cast("double").alias("y"), "counts").persist()
    try:
        seen = weighted_sums(rows.select(F.col("y").alias("pos"), (1 - F.col("y")).alias("neg"), "counts"), ["pos", "neg"], replicates).toArrow()
        known = np.zeros((2, replicates))
        known[:, seen.column("b").to_numpy()] = [seen.column(n).to_numpy() for n in ("pos", "neg")]

        def sums(batch: pa.RecordBatch, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = np.zeros((replicates, len(newton.SUMS)))
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x, y = (part.column(n).to_numpy(zero_copy_only=False)[:, None] for n in ("x", "y"))
                loss, r, v = newton.terms(a + b * x, y, decode(part.column("counts"), replicates))
                total += np.stack([t.sum(axis=0) for t in (loss, r, r * x, v, v * x, v * x * x)], axis=1)
            return total

        fit = newton.solve(rows, replicates, sums, (known == 0).any(axis=0), c=c, iterations=iterations)
    finally:
        rows.unpersist()
    ok = fit.status == newton.SETTLED
    found = [(int(i), *((float(fit.a[i]), float(fit.b[i])) if ok[i] else (None, None))) for i in range(replicates)]
    return cases.sparkSession.createDataFrame(found, "b int, calibration_intercept double, calibration_slope double")
