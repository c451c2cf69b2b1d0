"""Exact substring dedup: repeated windows by a depth-limited most-significant-digit radix sort of suffixes.

A suffix is ordered only through its first ``width`` bytes. The first digit is the mark of the window at the
suffix (see ``windows``): that pass is a shuffle, and suffixes alone with their digit leave at once. Suffixes
that remain are ordered by four digits of a quarter window each; after every pass groups of one leave. What is
left after the last digit are exactly the repeated windows. Stretches that recur as a whole are equal groups
already after the first two passes and are only counted.

Nulls: text null counts as empty; a null doc_id is a document of its own. Rows equal in id and text are
documents too and repeat each other. Empty tables give empty results. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage
from . import numeric as N
from . import windows as W

DIGITS = 4


def repeated_windows(h: np.ndarray, starts: np.ndarray, data: np.ndarray, width: int) -> np.ndarray:
    """Which windows at ``starts`` of ``data`` have an equal one; ``h`` is their first digit."""
    ranges = N.Ranges(N.byte_values(data))
    group, alive = np.unique(h, return_inverse=True)[1], np.arange(len(starts))
    cuts = np.linspace(0, width, DIGITS + 1).astype(np.int64)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        digit = ranges(starts[alive] + lo, starts[alive] + hi)
        order = np.lexsort((digit, group))
        g, d = group[order], digit[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        label = np.cumsum(new) - 1
        many = np.bincount(label)[label] > 1
        alive, group = alive[order][many], label[many]
        if not len(alive):
            break
    out = np.zeros(len(starts), bool)
    out[alive] = True
    return out


def spans(docs: DataFrame, width: int = 200, gram: int | None = None) -> DataFrame:
    """Stretches of repeated windows: (ka, kb, s, m) with first window and number of windows."""
    gram = gram or max(1, width * 8 // 25)
    text = W.keyed(docs)

    def mark(batches, known=None):
        for b in N.slices(batches, "text"):
            data, offsets = N.flat(b.column("text"))
            got = W.only(W.stretches(N.byte_values(data), offsets, width, gram), known)
            take = pa.array(got["row"])
            yield W.table({
                "h": N.signed(got["h"]), "x": N.signed(got["x"]), "ka": b.column("ka").take(take), "kb": b.column("kb").take(take),
                "s": got["s"].astype(np.int32), "m": got["m"].astype(np.int32), "twice": got["twice"],
            })

    schema = "h long, x long, ka long, kb long, s int, m int, twice boolean"
    marks = text.select("text", *W.KEY).mapInArrow(mark, schema)
    # The first pass tells which marks come again, the second sends only their stretches.
    again = cut_lineage(marks.groupBy("h").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("c")).where("c > 1").select("h"))
    known = W.BitFilter(again)
    marks = text.select("text", *W.KEY).mapInArrow(lambda batches: mark(batches, known), schema)
    # Rows equal in id and text are one key that counts several times.
    marks = cut_lineage(marks.join(again, "h", "left_semi").groupBy("h", "x", *W.KEY, "s", "m", "twice").agg(F.count(F.lit(1)).alias("rows")))
    whole = marks.groupBy("h", "x").agg(
        F.sum("rows").alias("n"), F.min(F.struct(*W.KEY, "s", "m")).alias("one"), F.max("twice").alias("twice")
    )
    groups = whole.groupBy("h").agg(F.count(F.lit(1)).alias("d"), F.max("twice").alias("t")).where("d > 1 or t")
    settled = marks.join(whole.where("n > 1").select("h", "x"), ["h", "x"], "left_semi").select(*W.KEY, "s", "m")
    # A stretch seen several times takes part only as a partner of the others.
    open_ = whole.join(groups.select("h", "d"), "h").select("h", "d", (F.col("n") == 1).alias("asks"), "one.*")
    listed = W.per_document(open_, ["h", "d", "asks", "s", "m"], "found")

    def cut(batches):
        for b in W.unpacked(batches):
            rows = {k: [] for k in ("h", "d", "asks", *W.KEY, "s", "m", "part")}
            for ka, kb, t, found in zip(*(b.column(c).to_pylist() for c in (*W.KEY, "text", "found"))):
                raw = t.encode()
                for f in found:
                    for k in ("h", "d", "asks", "s", "m"):
                        rows[k].append(f[k])
                    rows["ka"].append(ka)
                    rows["kb"].append(kb)
                    rows["part"].append(raw[f["s"] : f["s"] + f["m"] - 1 + width])
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

    parts = W.packed(text.select("text", *W.KEY)).join(listed, list(W.KEY)).dropDuplicates(list(W.KEY)).mapInArrow(
        cut, "h long, d long, asks boolean, ka long, kb long, s int, m int, part binary"
    )
    parts = cut_lineage(parts)
    few, many = W.hot_or_not(parts, F.col("d"))

    def resolve(rows: pa.Table):
        data, offsets = N.flat(rows.column("part"))
        m = rows.column("m").to_numpy().astype(np.int64)
        starts, row = N.spread(offsets[:-1], m), np.repeat(np.arange(len(m)), m)
        hit = repeated_windows(rows.column("h").to_numpy()[row], starts, data, width)
        hit &= rows.column("asks").to_numpy(zero_copy_only=False)[row]
        edge = np.zeros(len(row), bool)
        edge[1:] = row[1:] != row[:-1]
        new = hit & ~(np.concatenate([[False], hit[:-1]]) & ~edge)
        first, place = np.flatnonzero(new), np.flatnonzero(hit)
        length = np.bincount(np.cumsum(new)[place] - 1, minlength=len(first)) if len(first) else np.zeros(0, np.int64)
        take, s = pa.array(row[first]), rows.column("s").to_numpy()
        yield W.table({
            "ka": rows.column("ka").take(take).combine_chunks(), "kb": rows.column("kb").take(take).combine_chunks(),
            "s": (s[row[first]] + starts[first] - offsets[row[first]]).astype(np.int32), "m": length.astype(np.int32),
        })

    near = few.repartition("h").sortWithinPartitions("h").mapInArrow(W.by_groups(resolve, ["h"]), "ka long, kb long, s int, m int")

    def explode(batches):
        for b in N.slices(batches, "part", 1 << 18):
            data, offsets = N.flat(b.column("part"))
            m = b.column("m").to_numpy().astype(np.int64)
            starts, row = N.spread(offsets[:-1], m), np.repeat(np.arange(len(m)), m)
            values = N.byte_values(data)
            take = pa.array(row)
            yield W.table({
                "w1": N.signed(N.Ranges(values)(starts, starts + width)),
                "w2": N.signed(N.Ranges(values, N.BASES[1])(starts, starts + width)),
                "asks": b.column("asks").take(take), "ka": b.column("ka").take(take), "kb": b.column("kb").take(take),
                "s": (b.column("s").to_numpy()[row] + starts - offsets[row]).astype(np.int32),
            })

    each = many.mapInArrow(explode, "w1 long, w2 long, asks boolean, ka long, kb long, s int")
    equal = each.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w1", "w2")
    far = each.where("asks").join(equal, ["w1", "w2"], "left_semi").select(*W.KEY, "s", F.lit(1).alias("m"))
    return settled.unionByName(near).unionByName(far)


def remove_repeats(docs: DataFrame, width: int = 200, gram: int | None = None) -> DataFrame:
    """One row per document: sizes, removed runs as ``spans`` (start, end) and the bytes that stay as ``kept``."""
    found = W.per_document(spans(docs, width, gram), ["s", "m"], "found")
    text = W.packed(W.keyed(docs)).join(found, list(W.KEY), "left")

    def cut(batches):
        for b in W.unpacked(batches):
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")}
            for t, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist()):
                raw = t.encode()
                gone = np.zeros(len(raw), bool)
                if found:
                    s = np.array([f["s"] for f in found], np.int64)
                    gone = N.covered(s, s + np.array([f["m"] for f in found], np.int64) - 1 + width, len(raw))
                lo, hi = N.runs(gone)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(len(lo))
                out["spans"].append([{"start": int(a), "end": int(z)} for a, z in zip(lo, hi)])
                out["kept"].append(kept)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                     pa.binary(), pa.string())
            arrays = [b.column("doc_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *out])

    return text.select("doc_id", "packed", "found").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, "
        "kept binary, kept_sha256 string",
    )
