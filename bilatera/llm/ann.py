"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Every vector is taken relative to the mean, rotated by a fixed random rotation and kept as one bit per component with
correction scalars: its length, its inner product with its own code, and its product with the mean. An inner product
with a query is estimated from the bits alone, and its error is bounded by ``EPSILON`` standard deviations of what a random
rotation does. A vector is compared exactly when its upper bound reaches the query's current k-th best exact value, which
starts as the k-th best of a sample of about ``SAMPLE`` rows.

All rows are indexed, and the index is written once. Queries are sent to the index in blocks of fixed size; a task
returns its best k per query, which are merged. Vectors of another length than the query's are no candidates.
Vectors that are null, zero or not finite, and rows without vec_id, take no part. Rows with the query's vec_id are its
own. Repeated vectors are candidates of their own, ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage
from . import numeric as N
from . import vectors as V
from . import windows as W

EPSILON = 4.0
#: Queries that are sent to the tasks at once, and index rows that a task looks at in one step.
QUERIES, ROWS = 4096, 2048
#: Rows that give the first bounds.
SAMPLE = 4096


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def means(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of every length."""

    def add(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                m = V.matrix(b.column("embedding").filter(pa.array(dims == d)), d)
                sums[d] = sums.get(d, 0) + np.append(m.sum(axis=0), len(m))
        for d, s in sums.items():
            yield W.table({"dim": np.full(len(s), d, np.int32), "at": np.arange(len(s)), "s": s})

    got = rows.select("dim", "embedding").mapInArrow(add, "dim int, at long, s double").groupBy("dim", "at").agg(F.sum("s").alias("s")).collect()
    out: dict[int, dict[int, float]] = {}
    for r in got:
        out.setdefault(r["dim"], {})[r["at"]] = r["s"]
    return {d: np.array([s[i] for i in range(d)]) / s[d] for d, s in out.items()}


def index(rows: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """Every row with its packed code and correction scalars."""

    def encode(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = pa.Table.from_batches([b]).filter(pa.array(dims == d)).combine_chunks()
                m = V.matrix(part.column("embedding").combine_chunks(), d)
                rest = m - centre[d]
                length = np.linalg.norm(rest, axis=1)
                turned = (rest @ rotation(d)) / np.maximum(length, 1e-300)[:, None]
                codes = np.packbits(turned > 0, axis=1)
                own = np.abs(turned).sum(axis=1) / np.sqrt(d)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").combine_chunks(), part.column("dim").combine_chunks(), part.column("embedding").combine_chunks(),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(own)],
                    names=["vec_id", "dim", "embedding", "code", "length", "own"])

    return cut_lineage(rows.select("vec_id", "dim", "embedding").mapInArrow(
        encode, "vec_id long, dim int, embedding array<double>, code binary, length double, own double"
    ))


class _Best:
    """The k best exact values of a block of queries so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray):
        self.ids, self.queries, self.k, self.least = ids, queries, k, least
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def bound(self, some: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[some, -1], self.least[some])

    def add(self, ids: np.ndarray, exact: np.ndarray, query: np.ndarray, row: np.ndarray) -> None:
        """Score (query, row) pairs exactly and keep the best."""
        for lo in range(0, len(query), 50_000):
            q, r = query[lo : lo + 50_000], row[lo : lo + 50_000]
            # In any order of summation first; what may be among the best is summed in the order of the components.
            s = np.einsum("ij,ij->i", exact[r], self.queries[q])
            best = s >= self.bound(q) - 1e-9 * (1 + np.abs(s))
            q, r = q[best], r[best]
            if not len(q):
                continue
            s = V.dots(exact[r], self.queries[q])
            touched = np.unique(q)
            have = np.repeat(touched, self.k)
            every_q = np.concatenate([have, q])
            every_s = np.concatenate([self.score[touched].ravel(), s])
            every_id = np.concatenate([self.found[touched].ravel(), ids[r]])
            order = np.lexsort((every_id, -every_s, every_q))
            first = np.searchsorted(every_q[order], touched)
            take = order[(first[:, None] + np.arange(self.k)).ravel()]
            self.score[touched] = every_s[take].reshape(-1, self.k)
            self.found[touched] = every_id[take].reshape(-1, self.k)


def search(rows: DataFrame, is_query: F.Column | None = None, k: int = 20, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score), nearest first."""
    rows = V.prepared(rows)
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    centre = means(rows)
    table = index(rows, centre)
    # Queries are numbered before they are written; a block of numbers is what is sent at once.
    asked = cut_lineage(table.where(is_query).select("vec_id", "dim", "embedding").distinct().withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-table.where(is_query).count() // QUERIES))))
    ))
    sample = -(-1_000_000 * SAMPLE // max(table.count(), 1))
    sample = table.where(F.pmod(F.xxhash64(F.lit(31), "vec_id"), F.lit(1_000_000)) < sample)
    blocks = [(r["block"], r["dim"]) for r in asked.select("block", "dim").distinct().orderBy("block", "dim").collect()]
    parts = []
    for number, dim in blocks:
        got = asked.where((F.col("block") == number) & (F.col("dim") == dim)).select("vec_id", "embedding").toArrow().combine_chunks()
        ids, queries = got.column("vec_id").to_numpy(), V.matrix(got.column("embedding").combine_chunks(), dim)
        seen = sample.where(F.col("dim") == dim).select("vec_id", "embedding").toArrow().combine_chunks()
        least = np.full(len(ids), -np.inf)
        if seen.num_rows > k:
            other = V.matrix(seen.column("embedding").combine_chunks(), dim)
            for lo in range(0, len(ids), 512):
                s = np.where(ids[lo : lo + 512, None] != seen.column("vec_id").to_numpy(), queries[lo : lo + 512] @ other.T, -np.inf)
                least[lo : lo + 512] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            least -= 1e-9 * (1 + np.abs(least))
        sent = rows.sparkSession.sparkContext.broadcast((ids, queries, least))

        def look(batches: Iterator[pa.RecordBatch], sent=sent, dim=dim):
            ids, queries, least = sent.value
            best = _Best(ids, queries, k, least)
            turned = (queries @ rotation(dim)).astype(np.float32)
            norm, middle = np.linalg.norm(queries, axis=1).astype(np.float32), (queries @ centre[dim]).astype(np.float32)
            by_id = np.argsort(ids, kind="stable")
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    exact, own_ids = V.matrix(part.column("embedding"), dim), part.column("vec_id").to_numpy()
                    code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(exact), -1)
                    bits = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
                    length, own = part.column("length").to_numpy(), np.maximum(part.column("own").to_numpy(), 1e-9)
                    scale = (length / own / np.sqrt(dim)).astype(np.float32)
                    # The last term covers the rounding of single precision.
                    spread = length * (epsilon * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(max(dim - 1, 1)) + 1e-4)
                    spread = (spread + 1e-4 * np.linalg.norm(centre[dim])).astype(np.float32)
                    first, last = (np.searchsorted(ids[by_id], own_ids, side=side) for side in ("left", "right"))
                    same_row, same_query = np.repeat(np.arange(len(exact)), last - first), by_id[N.spread(first, last - first)]
                    for lo in range(0, len(ids), 256):
                        some = np.arange(lo, min(lo + 256, len(ids)))
                        estimate = turned[some] @ bits.T
                        estimate *= scale
                        estimate += middle[some, None]
                        # Rows with the query's own id are no candidates.
                        mine = (same_query >= lo) & (same_query < lo + len(some))
                        estimate[same_query[mine] - lo, same_row[mine]] = -np.inf
                        bound = best.bound(some)
                        if len(exact) > k and not np.isfinite(bound).all():
                            # A first bound: the exact values of those that look best.
                            top = np.argpartition(-estimate, k, axis=1)[:, :k]
                            q, r = np.repeat(np.arange(len(some)), k), top.ravel()
                            fair = np.isfinite(estimate[q, r])
                            best.add(own_ids, exact, some[q[fair]], r[fair])
                            estimate[q, r] = -np.inf
                            bound = best.bound(some)
                        reach = estimate + norm[some, None] * spread
                        q, r = np.nonzero((reach >= bound[:, None].astype(np.float32)) & (estimate > -np.inf))
                        if len(q):
                            best.add(own_ids, exact, some[q], r)
            q, rank = np.nonzero(np.isfinite(best.score))
            yield W.table({"query": q, "query_id": ids[q], "vec_id": best.found[q, rank], "score": best.score[q, rank]})

        near = table.where(F.col("dim") == dim).select("vec_id", "embedding", "code", "length", "own").mapInArrow(
            look, "query long, query_id long, vec_id long, score double"
        )
        parts.append(near.withColumn("query", F.struct(F.lit(number).alias("block"), F.lit(dim).alias("dim"), "query")))
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
