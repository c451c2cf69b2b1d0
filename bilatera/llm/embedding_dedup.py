"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors of one label are normalised and hashed in several tables: random projections, shifted and cut into cells, as many
at once as make unlike vectors part. At cosine 0.98 (distance 0.2) and cells of width 1.6 two vectors share a
projection's cell with chance 0.90 and all 20 of a table with 0.12, so all 90 tables miss them with chance 1e-5; vectors at
distance 1 meet in a table with chance 3e-6. Those that share a bucket are candidates, and cosines are exact, in
doubles. Equal vectors of one label are one member with a weight.

Vectors that are null, zero or not finite, and those without label or vec_id, link with nothing and stay. Rows that
repeat a vec_id count as vectors of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage
from . import candidates as C
from . import numeric as N
from . import vectors as V

THRESHOLD = 0.98
TABLES, CUTS, WIDTH = 90, 20, 1.6


def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(dim * 1000 + 7)
    return rng.standard_normal((dim, TABLES * CUTS)), rng.uniform(0, WIDTH, TABLES * CUTS)


def table_hashes(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows x tables."""
    lines, shift = projections(unit.shape[1])
    cell = np.floor((unit @ lines + shift) / WIDTH).astype(np.int64).view(N.U).reshape(len(unit), TABLES, CUTS)
    h = np.arange(1, TABLES + 1).astype(N.U)[None, :] * N.U(N.BASES[1]) + N.mix(label.astype(np.int64).view(N.U) + N.U(unit.shape[1] << 40))[:, None]
    for j in range(CUTS):
        h = N.mix(h * N.U(N.BASES[0]) + cell[:, :, j])
    return h


def cosine_links(payloads: list, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs with cosine at or above the threshold; only those near it are summed in order of the components."""
    sizes = np.array([p.size for p in payloads])
    out = np.zeros(len(left), bool)
    for size in np.unique(sizes):
        mine = sizes == size
        pairs = np.flatnonzero(mine[left] & mine[right])
        m = np.zeros((len(payloads), size // 8))
        m[mine] = np.frombuffer(b"".join(bytes(p) for p, ok in zip(payloads, mine) if ok)).reshape(-1, size // 8)
        unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        close = pairs[(unit @ unit.T)[left[pairs], right[pairs]] >= THRESHOLD - 1e-6]
        a, b = m[left[close]], m[right[close]]
        out[close] = V.dots(a, b) / (np.sqrt(V.dots(a, a)) * np.sqrt(V.dots(b, b))) >= THRESHOLD
    return out


def near_duplicates(rows: DataFrame) -> DataFrame:
    """One row per vector: vec_id, label, n_links, component_id, kept."""
    key = [F.xxhash64("label", "embedding").alias("ka"), F.xxhash64("embedding", F.lit(13), "label").alias("kb")]
    takes_part = V.usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    vectors = V.prepared(rows.where(F.col("label").isNotNull()), F.col("label").cast("long").alias("label")).select(
        "vec_id", "label", "dim", "embedding", *key
    )
    members = cut_lineage(
        vectors.groupBy("ka", "kb").agg(
            F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"), F.first("label").alias("label"),
            F.first("dim").alias("dim"), F.first("embedding").alias("embedding"),
        ).withColumn("id", F.monotonically_increasing_id())
    )

    def buckets(b: pa.RecordBatch):
        dims, at, found = b.column("dim").to_numpy(), [], []
        label = b.column("label").to_numpy()
        for d in np.unique(dims).tolist():
            mine = np.flatnonzero(dims == d)
            m = V.matrix(b.column("embedding").take(pa.array(mine)), d)
            for lo in range(0, len(mine), 512):
                some = m[lo : lo + 512]
                h = table_hashes(some / np.linalg.norm(some, axis=1, keepdims=True), label[mine[lo : lo + 512]])
                at.append(np.repeat(mine[lo : lo + 512], TABLES))
                found.append(h.ravel())
        return np.concatenate(at), np.concatenate(found)

    grouped = C.groups(members, buckets, ["label", "dim", "embedding"])

    def pack(batches):
        for b in batches:
            raw = pa.array([np.array(v, np.float64).tobytes() for v in b.column("embedding").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "component", "weight")), raw], names=["id", "component", "weight", "raw"])

    raw = grouped.join(members, "id").select("id", "component", "weight", "embedding").mapInArrow(pack, "id long, component long, weight long, raw binary")
    counts, reached = C.summary(C.links(raw, cosine_links, "raw"))
    named = members.select("ka", "kb", "id", "weight", "first").join(counts, "id", "left").join(reached, "id", "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select(
        "ka", "kb", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    keyed = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), takes_part.alias("in"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).select("vec_id", "label", *[F.when(F.col("in"), c).alias(n) for c, n in zip(key, ("ka", "kb"))])
    component = F.coalesce("component_id", "vec_id")
    return keyed.join(named, ["ka", "kb"], "left").select(
        "vec_id", "label", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
