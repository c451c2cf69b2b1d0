"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte n-grams of its lower-case form, where ASCII characters other
than letters count as one space between words. Document frequencies come from
all labelled training documents. Every language gets several centroids, clustered by cosine from a sample of at
most about ``sample`` training documents of that language, chosen by a hash of their content. A text gets the
language of the nearest centroid; it is marked as rejected where its cosine lies below what nearly all sample texts
of that centroid reach. Only text is an input of the prediction.

Training uses documents with a language whose crc32(doc_id as text) mod 4 is not 2; a null doc_id is neither trained on
nor held out. Null text and text without a letter are ``und`` with score 0, and so is everything where nothing
could be learned. Repeated rows are predicted alike. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numeric as N
from . import windows as W

BITS = 13
GRAMS = (2, 3, 4)
CLUSTERS = 4
#: Texts that are counted together; each takes a dense row of counts.
ROWS = 256
#: Training documents of a language that its centroids are clustered from.
SAMPLE = 1000
#: Share of sample texts that lie farther from their centroid than the rejection distance.
REJECT = 0.001


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Texts x hashed n-grams."""
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b"".join(b" %b " % t for t in raw), np.uint8)
    row = np.repeat(np.arange(len(raw)), [len(t) + 2 for t in raw])
    gap = (data < 128) & ((data < 97) | (data > 122))
    keep = ~gap
    keep[1:] |= ~gap[:-1] | (row[1:] != row[:-1])
    keep[:1] = True  # every text begins with a gap, the first one too
    data, row = np.where(gap, 0x20, data).astype(np.uint8)[keep], row[keep]
    total = np.zeros(len(raw) << BITS, np.int64)
    values = N.byte_values(data)
    for n in GRAMS:
        if len(data) < n:
            continue
        key = np.zeros(len(data) - n + 1, N.U)
        for k in range(n):
            key = (key << N.U(9)) | values[k : k + len(key)]
        slot = (N.mix(key + N.U(n << 56)) >> N.U(64 - BITS)).astype(np.int64)
        inside = row[: len(key)] == row[n - 1 :]
        total += np.bincount((row[: len(key)][inside] << BITS) + slot[inside], minlength=len(total))
    return total.reshape(len(raw), 1 << BITS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts, dtype=np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(v: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts; centroids and the cosine of every row to its own."""
    centres = [v[0]]
    while len(centres) < min(k, len(v)):
        centres.append(v[int(np.argmin(np.max(v @ np.array(centres).T, axis=1)))])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                mean = v[own == j].mean(axis=0)
                c[j] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    near = v @ c.T
    return c, np.max(near, axis=1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    owner: np.ndarray
    bound: np.ndarray


def fit(docs: DataFrame, *, clusters: int = CLUSTERS, sample: int = SAMPLE, reject: float = REJECT) -> Model | None:
    train = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    train = W.keyed(train, "lang")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None

    def frequencies(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in N.slices(batches, "text", rows=ROWS):
            counts = term_counts(b.column("text").to_pylist())
            df += (counts > 0).sum(axis=0)
            n += len(counts)
        slot = np.flatnonzero(df)
        yield W.table({"slot": np.append(slot, -1), "n": np.append(df[slot], n)})

    found = train.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = found.column("slot").to_numpy(), found.column("n").to_numpy()
    total, df = int(n[slot < 0].sum()), np.zeros(1 << BITS, np.float64)
    df[slot[slot >= 0]] = n[slot >= 0]
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 0.01

    share = F.lit(1_000_000)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(-(-1_000_000 * sample // size))).otherwise(share)
    picked = train.where(F.pmod(F.col("ka"), F.lit(1_000_000)) < share).select("lang", "text")

    def sparse(batches):
        for b in N.slices(batches, "text", rows=ROWS):
            counts = term_counts(b.column("text").to_pylist())
            rows = [np.flatnonzero(c).astype(np.int32) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), pa.array([r.tobytes() for r in rows], pa.binary()),
                 pa.array([c[r].astype(np.int32).tobytes() for c, r in zip(counts, rows)], pa.binary())], names=["lang", "slots", "counts"])

    rows = picked.mapInArrow(sparse, "lang string, slots binary, counts binary").toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("slots", "ascending"), ("counts", "ascending")])
    names, slots, values = (rows.column(c).to_pylist() for c in ("lang", "slots", "counts"))
    languages, centres, owner, bound = sorted(sizes), [], [], []
    for k, lang in enumerate(languages):
        mine = [i for i, x in enumerate(names) if x == lang]
        if not mine:
            continue
        dense = np.zeros((len(mine), 1 << BITS), np.float32)
        for i, j in enumerate(mine):
            dense[i, np.frombuffer(slots[j], np.int32)] = np.frombuffer(values[j], np.int32)
        c, near = cluster(vectors(dense, idf), clusters)
        centres.append(c)
        owner += [k] * len(c)
        bound += [float(np.quantile(near, reject))] * len(c)
    if not centres:
        return None
    return Model(languages, idf, np.concatenate(centres), np.array(owner), np.array(bound))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"),
    )

    def nearest(batches):
        for b in N.slices(batches, "text", rows=ROWS):
            letters = b.column("_letters").to_numpy(zero_copy_only=False)
            names, score, off = ["und"] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            if model is not None:
                cosine = vectors(term_counts(b.column("text").to_pylist()), model.idf) @ model.centres.T
                best = np.argmax(cosine, axis=1)
                top = cosine[np.arange(len(best)), best]
                names = [model.languages[model.owner[j]] if ok else "und" for j, ok in zip(best, letters)]
                score = np.where(letters, np.clip(top, 0, 1), 0).astype(np.float64)
                off = ~letters | (top < model.bound[best])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(off)],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return text.mapInArrow(nearest, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
