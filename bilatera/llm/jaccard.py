"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles. Equal sets are one class, found by a fingerprint. Classes whose MinHash values agree
in all rows of a band become candidates: with 45 bands of 6 a pair at the threshold 0.8 is missed with a chance of
1.1e-6, a pair at 0.9 with 1e-15. Candidate pairs compare their MinHash values step by step and leave as soon as the
posterior chance that their similarity reaches the threshold, with a flat prior, is below ``TOLERANCE``; with m of n
values equal that chance is P(Binomial(n + 1, threshold) <= m). The rest is verified on the sets themselves.

Words are what white space separates. A text of fewer words than a shingle is one shingle. Texts without words, null
among them, are copies of each other and similar to nothing else. A null doc_id takes part and never names a class. Rows that repeat are copies, which link.
"""

from __future__ import annotations

from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage
from . import candidates as C
from . import numeric as N
from . import windows as W

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 45, 6
STEP, TOLERANCE = 30, 1e-9
_FACTORS = (np.random.default_rng(20240501).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted, and their offsets."""
    starts, ends, firsts = N.words(data, offsets)
    values, count = N.word_values(data, starts, ends), np.diff(firsts)
    ranges = N.Ranges(values)
    have = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at, row = N.spread(firsts[:-1], have), np.repeat(np.arange(len(count)), have)
    h = ranges(at, np.minimum(at + width, firsts[1:][row]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(count)))])


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values of nonempty sets."""
    short, firsts = (h >> N.U(32)).astype(np.uint32), offsets[:-1]
    out = np.empty((len(firsts), len(_FACTORS)), np.uint32)
    for i, f in enumerate(_FACTORS):
        x = short * f
        out[:, i] = np.minimum.reduceat(x ^ (x >> np.uint32(15)), firsts)
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    out = np.empty((len(signature), BANDS), N.U)
    for b in range(BANDS):
        k = np.full(len(signature), b + 1, N.U)
        for j in range(ROWS):
            k = N.mix(k * N.U(31) + signature[:, b * ROWS + j])
        out[:, b] = k
    return out


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values of ``n`` that leave a posterior chance of ``tolerance`` of reaching the threshold."""
    total, m = 0.0, 0
    while m <= n:
        total += np.exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
        if total >= tolerance:
            return m
        m += 1
    return n


def similar(sets: list, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of shingle sets reach the threshold."""
    sets = [np.frombuffer(s, N.U) for s in sets]
    n = np.array([len(s) for s in sets])
    keep = np.minimum(n[left], n[right]) >= threshold * np.maximum(n[left], n[right]) - 1e-9
    alive = np.flatnonzero(keep)
    offsets = np.concatenate([[0], np.cumsum(n)])
    everything = np.concatenate(sets)
    signature = signatures(everything, offsets)
    same = np.zeros(len(alive), np.int64)
    for lo in range(0, signature.shape[1], STEP):
        part = signature[:, lo : lo + STEP]
        for k in range(0, len(alive), 20_000):
            some = alive[k : k + 20_000]
            same[k : k + 20_000] += (part[left[some]] == part[right[some]]).sum(axis=1)
        stay = same >= least_matches(lo + part.shape[1], threshold, TOLERANCE)
        alive, same = alive[stay], same[stay]
    out = np.zeros(len(left), bool)
    if not len(alive):
        return out
    common = C.common_counts(sets, left[alive], right[alive])
    out[alive] = common / (n[left[alive]] + n[right[alive]] - common) >= threshold
    return out


def join(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, ka, kb, class_id, component_id, n_links, kept, copy).

    ``class_id`` is the smallest doc_id with the same shingles, ``component_id`` the smallest reachable by links,
    ``n_links`` the number of other documents at the threshold or above, ``kept`` the row that stands for the component.
    """
    text = W.keyed(docs)

    def fingerprint(batches):
        for b in N.slices(batches, "text"):
            h, offsets = shingles(*N.flat(b.column("text")), width)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            sums = np.zeros((2, b.num_rows), N.U)
            bands = np.zeros((b.num_rows, BANDS), np.int64)
            if len(full):
                at = offsets[full]
                sums[0, full] = np.add.reduceat(h, at)
                sums[1, full] = np.add.reduceat(N.mix(h ^ N.U(N.BASES[1])), at)
                bands[full] = N.signed(band_hashes(signatures(h, np.append(at, len(h)))))
            packed = pa.array([row.tobytes() for row in bands], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("ka"), b.column("kb"), pa.array(N.signed(N.mix(sums[0]))), pa.array(N.signed(N.mix(sums[1]))),
                 pa.array(n.astype(np.int64)), packed], names=["doc_id", "ka", "kb", "f1", "f2", "n", "bands"])

    marked = text.mapInArrow(fingerprint, "doc_id long, ka long, kb long, f1 long, f2 long, n long, bands binary")
    # The id of a class is given before the table is written, so later reads agree on it.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "ka", "kb")
    classes = cut_lineage(
        marked.groupBy("f1", "f2").agg(
            F.count(F.lit(1)).alias("weight"), F.min(row).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands")
        ).withColumn("id", F.monotonically_increasing_id())
    )

    def buckets(b: pa.RecordBatch):
        data, _ = N.flat(b.column("bands"))
        return np.repeat(np.arange(b.num_rows), BANDS), np.frombuffer(data, N.U)

    grouped = C.groups(classes.where("n > 0"), buckets, ["bands"])
    members = grouped.join(classes.select("id", "weight", "one.ka", "one.kb"), "id")

    def read(batches):
        for b in N.slices(batches, "text"):
            h, offsets = shingles(*N.flat(b.column("text")), width)
            sets = pa.array([h[lo:hi].tobytes() for lo, hi in zip(offsets[:-1], offsets[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "component", "weight")), sets], names=["id", "component", "weight", "set"])

    sets = text.select("text", *W.KEY).join(members, list(W.KEY)).select("text", "id", "component", "weight").mapInArrow(
        read, "id long, component long, weight long, set binary"
    )
    counts, reached = C.summary(C.links(sets, lambda s, i, j: similar(s, i, j, threshold), "set"))
    named = classes.select("f1", "f2", "id", "weight", "one").join(counts, "id", "left").join(reached, "id", "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    best = named.groupBy("component").agg(F.min("one").alias("best"))
    named = named.join(best, "component").select(
        "f1", "f2", F.col("one.doc_id").alias("class_id"), F.col("best.doc_id").alias("component_id"), "best",
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    # Of rows equal in id and text one stays.
    copy = F.row_number().over(Window.partitionBy("ka", "kb").orderBy("n"))
    rows = marked.select("doc_id", "ka", "kb", "f1", "f2", "n").withColumn("copy", copy).join(named, ["f1", "f2"], "left")
    chosen = (F.col("best.ka") == F.col("ka")) & (F.col("best.kb") == F.col("kb")) & (F.col("copy") == 1)
    return rows.select(
        "doc_id", "ka", "kb", "class_id", "component_id", F.col("n_links").cast("long").alias("n_links"), chosen.alias("kept"), "copy",
    )
