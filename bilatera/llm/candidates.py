"""From hash buckets to verified links without a row per pair.

Members of a bucket are tied to its smallest member; connected members form a candidate group that holds every pair
that shares a bucket. A group is compared exactly, in tasks of two blocks of bounded size each, so one group of any
size is spread over many tasks. A task returns numbers of links per member and a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage
from . import numeric as N
from . import windows as W
from .components import components

BLOCK = 256


def groups(rows: DataFrame, buckets: Callable, columns: list[str]) -> DataFrame:
    """(id, component) of members that share a bucket with another, directly or through others.

    ``buckets`` maps an Arrow batch of ``columns`` to (position in the batch, bucket) for every bucket of a row.
    """

    def emit(batches: Iterator[pa.RecordBatch], known=None) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, h = buckets(b)
            if known is not None:
                keep = known(h)
                at, h = at[keep], h[keep]
            yield W.table({"h": N.signed(h), "id": b.column("id").take(pa.array(at))})

    rows = rows.select("id", *columns)
    shared = cut_lineage(
        rows.mapInArrow(emit, "h long, id long").groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("h", "a")
    )
    known = W.BitFilter(shared)
    again = rows.mapInArrow(lambda batches: emit(batches, known), "h long, id long").join(shared, "h")
    return components(again.select(F.col("id").alias("a"), F.col("a").alias("b")).where("a <> b"))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over ``n`` members."""
    parent, out = list(range(n)), []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = i, j
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


@lru_cache(maxsize=256)
def _pairs(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size, 1)


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, many pairs at once."""
    n = np.array([len(s) for s in sets])
    offsets, everything = np.concatenate([[0], np.cumsum(n)]), np.concatenate(sets)
    ids = np.unique(everything, return_inverse=True)[1]
    out, work = np.zeros(len(left), np.int64), np.cumsum(n[left] + n[right])
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + most, side="right")))
        l, r = left[at:end], right[at:end]
        pair = np.concatenate([np.repeat(np.arange(len(l)), n[l]), np.repeat(np.arange(len(r)), n[r])])
        value = np.concatenate([ids[N.spread(offsets[l], n[l])], ids[N.spread(offsets[r], n[r])]])
        both = np.sort(pair * np.int64(len(everything) + 1) + value)
        out[at:end] = np.bincount(both[1:][both[1:] == both[:-1]] // (len(everything) + 1), minlength=len(l))
        at = end
    return out


def counts_and_forest(ids: np.ndarray, weight: np.ndarray, payloads: list, i: np.ndarray, j: np.ndarray):
    """Links of every member by weight, and the edges of a spanning forest."""
    n = (np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))).astype(np.int64)
    for k in np.flatnonzero(n).tolist():
        yield int(ids[k]), None, int(n[k])
    for x, y in forest(i, j, len(ids)):
        yield int(ids[x]), int(ids[y]), 0


def links(members: DataFrame, compare: Callable, payload: str, outcome: Callable = counts_and_forest, block: int = BLOCK) -> DataFrame:
    """(a, b, n): rows with b null give ``n`` links (by weight) of member a, the others are forest edges.

    ``members``: id, component, weight and one binary column. ``compare(payloads, left, right)`` says which of
    the index pairs are links, ``outcome`` what is told of them.
    """
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    blocks = F.ceil(F.col("_size") / block)
    dealt = members.join(size, "component").withColumn("_own", F.pmod(F.xxhash64("id"), blocks)).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    )
    dealt = dealt.select(
        "component", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), "_own", "id", "weight", payload
    )

    def verify(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = [rows.column(c).to_numpy() for c in ("component", "lo", "hi")]
        own, ids, weight = (rows.column(c).to_numpy() for c in ("_own", "id", "weight"))
        order = np.lexsort((ids, key[2], key[1], key[0]))
        sorted_ = [k[order] for k in key]
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in sorted_], axis=0)
        # Equal rows bring a member twice into a group.
        keep = new | np.append(True, ids[order[1:]] != ids[order[:-1]])
        order, new = order[keep], new[keep]
        firsts = np.append(np.flatnonzero(new), len(order))
        lefts, rights = [], []
        for lo, size in zip(firsts[:-1].tolist(), np.diff(firsts).tolist()):
            if size > 1:
                i, j = _pairs(size)
                lefts.append(i + lo)
                rights.append(j + lo)
        if not lefts:
            return
        i, j = np.concatenate(lefts), np.concatenate(rights)
        lo, hi, own, ids, weight = (x[order] for x in (key[1], key[2], own, ids, weight))
        cross = (lo[i] == hi[i]) | (own[i] != own[j])
        i, j = i[cross], j[cross]
        payloads = [rows.column(payload)[int(k)].as_buffer() for k in order]
        hit = compare(payloads, i, j)
        a_out, b_out, n_out = [], [], []
        for a, b, n in outcome(ids, weight, payloads, i[hit], j[hit]):
            a_out.append(a)
            b_out.append(b)
            n_out.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a_out, b_out, n_out)], names=["a", "b", "n"])

    keys = ["component", "lo", "hi"]
    spread = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return cut_lineage(spread.mapInArrow(W.by_groups(verify, keys, 1 << 22), "a long, b long, n long"))


def summary(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, links) and (id, component) from the rows of ``links``."""
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    return counts, components(found.where("b is not null").select("a", "b"))
