"""Substring dedup over words against all earlier documents, with factors of the reference.

The reference is the whole corpus, indexed by the marks of its windows (see ``windows``) and sharded by mark:
an entry is a stretch of windows with the smallest doc_id that holds it. Every document looks its stretches up
in every shard that has one of its marks. A stretch that an earlier document holds as a whole is a phrase;
where only parts of it may be known, its windows are compared with the other entries of the mark, so phrases
are exact at their edges too. These window joins decide which words go. ``factors`` describes them afterwards: phrases that go on at
the same place of the same reference document are one factor. It is no longest-match parse and changes no word.

Only a smaller doc_id counts as a reference. Documents without doc_id are no reference and lose nothing, nor do
rows of one doc_id to each other. Null text has no words. Extra columns of the input are ignored.
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

FACTOR = "array<struct<start:long,length:long,ref_doc:long,ref_start:long>>"
PHRASE = ["s", "m", "ref_doc", "ref_s"]


def _window_hashes(data: np.ndarray, offsets: np.ndarray, m: np.ndarray, width: int):
    """128 bits for each of the ``m`` windows of every text, and the text and place of each."""
    starts, ends, firsts = N.words(data, offsets)
    at, row = N.spread(firsts[:-1], m), np.repeat(np.arange(len(m)), m)
    one = N.Ranges(N.word_values(data, starts, ends))(at, at + width)
    two = N.Ranges(N.word_values(data, starts, ends, N.BASES[1]), N.BASES[1])(at, at + width)
    return one, two, row, at - firsts[row]


def phrases(docs: DataFrame, width: int = 13, gram: int | None = None) -> DataFrame:
    """(ka, kb, s, m, ref_doc, ref_s): ``m`` windows from word ``s`` that start in an earlier document at ``ref_s``."""
    gram = gram or max(1, width // 2)
    text = W.keyed(docs).where(F.col("doc_id").isNotNull())

    def mark(batches, known=None):
        for b in N.slices(batches, "text"):
            data, offsets = N.flat(b.column("text"))
            starts, ends, firsts = N.words(data, offsets)
            got = W.only(W.stretches(N.word_values(data, starts, ends), firsts, width, gram), known)
            take = pa.array(got["row"])
            yield W.table({
                "h": N.signed(got["h"]), "x": N.signed(got["x"]), **{c: b.column(c).take(take) for c in ("doc_id", *W.KEY)},
                "s": got["s"].astype(np.int32), "m": got["m"].astype(np.int32),
            })

    schema = "h long, x long, doc_id long, ka long, kb long, s int, m int"
    marks = text.mapInArrow(mark, schema)
    # The first pass tells which marks several documents have, the second sends only their stretches.
    shared = cut_lineage(
        marks.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    )
    known = W.BitFilter(shared)
    marks = cut_lineage(text.mapInArrow(lambda batches: mark(batches, known), schema).join(shared, "h", "left_semi"), spent=[shared])
    index = cut_lineage(marks.groupBy("h", "x").agg(F.min(F.struct("doc_id", "s")).alias("ref")))
    groups = index.groupBy("h").agg(F.count(F.lit(1)).alias("d"), F.min("ref.doc_id").alias("lowest")).where("d > 1")
    # Rows equal in id and text are one key: they are no source for each other. What both later plans read is written, the marks go.
    found = marks.join(index.hint("merge"), ["h", "x"]).dropDuplicates(["h", "x", *W.KEY, "s"])
    found = cut_lineage(found.select("h", "doc_id", *W.KEY, "s", "m", F.col("ref.doc_id").alias("ref_doc"), F.col("ref.s").alias("ref_s")), spent=[marks])
    copies = found.where("doc_id > ref_doc").select(*W.KEY, *PHRASE)
    open_ = found.where("doc_id = ref_doc").join(groups, "h").select(
        "h", "d", (F.col("doc_id") > F.col("lowest")).alias("asks"), *W.KEY, "s", "m"
    )
    listed = W.per_document(open_, ["h", "d", "asks", "s", "m"], "found")

    def cut(batches):
        for b in W.unpacked(batches):
            data, offsets = N.flat(b.column("text"))
            starts, ends, firsts = N.words(data, offsets)
            raw, rows = data.tobytes(), {k: [] for k in ("h", "d", "asks", "doc_id", *W.KEY, "s", "m", "part")}
            for i, (doc, ka, kb, found) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", *W.KEY, "found")))):
                for f in found:
                    for k in ("h", "d", "asks", "s", "m"):
                        rows[k].append(f[k])
                    for k, v in (("doc_id", doc), ("ka", ka), ("kb", kb)):
                        rows[k].append(v)
                    w = firsts[i] + f["s"]
                    rows["part"].append(raw[starts[w] : ends[w + f["m"] + width - 2]])
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

    parts = cut_lineage(W.packed(text).join(listed, list(W.KEY)).dropDuplicates(list(W.KEY)).mapInArrow(
        cut, "h long, d long, asks boolean, doc_id long, ka long, kb long, s int, m int, part binary"
    ), spent=[index])
    few, many = W.hot_or_not(parts, F.col("d"))

    def resolve(rows: pa.Table):
        data, offsets = N.flat(rows.column("part"))
        doc, s, m = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "s", "m"))
        one, two, row, j = _window_hashes(data, offsets, m, width)
        order = np.lexsort((s[row], doc[row], two, one))
        a, b = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        best = np.empty(len(order), np.int64)
        best[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        ref_doc, ref_s = doc[row[best]], s[row[best]] + j[best]
        hit = np.flatnonzero((ref_doc < doc[row]) & rows.column("asks").to_numpy(zero_copy_only=False)[row])
        place = s[row[hit]] + j[hit]
        same = np.zeros(len(hit), bool)
        same[1:] = (row[hit[1:]] == row[hit[:-1]]) & (hit[1:] == hit[:-1] + 1) & (ref_doc[hit[1:]] == ref_doc[hit[:-1]])
        same[1:] &= (ref_s[hit[1:]] - place[1:]) == (ref_s[hit[:-1]] - place[:-1])
        first = np.flatnonzero(~same)
        take = pa.array(row[hit[first]])
        yield W.table({
            **{c: rows.column(c).take(take).combine_chunks() for c in W.KEY}, "s": place[first].astype(np.int32),
            "m": np.diff(np.append(first, len(hit))).astype(np.int32), "ref_doc": ref_doc[hit[first]],
            "ref_s": ref_s[hit[first]].astype(np.int32),
        })

    near = few.repartition("h").sortWithinPartitions("h").mapInArrow(W.by_groups(resolve, ["h"]), "ka long, kb long, s int, m int, ref_doc long, ref_s int")

    def explode(batches):
        for b in N.slices(batches, "part", 1 << 18):
            data, offsets = N.flat(b.column("part"))
            one, two, row, j = _window_hashes(data, offsets, b.column("m").to_numpy().astype(np.int64), width)
            take = pa.array(row)
            yield W.table({
                "w1": N.signed(one), "w2": N.signed(two), **{c: b.column(c).take(take) for c in ("asks", "doc_id", *W.KEY)},
                "s": (b.column("s").to_numpy()[row] + j).astype(np.int32),
            })

    each = many.mapInArrow(explode, "w1 long, w2 long, asks boolean, doc_id long, ka long, kb long, s int")
    first = each.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "s")).alias("ref"))
    far = each.where("asks").join(first, ["w1", "w2"]).where("doc_id > ref.doc_id").select(
        *W.KEY, "s", F.lit(1).alias("m"), F.col("ref.doc_id").alias("ref_doc"), F.col("ref.s").alias("ref_s")
    )
    return copies.unionByName(near).unionByName(far)


def factors(found: list[dict], width: int) -> list[dict]:
    """Greedy factors in words: a factor grows while the next phrase continues the same reference text."""
    out: list[dict] = []
    for p in sorted(found, key=lambda p: (p["s"], -p["m"])):
        last = out[-1] if out else None
        shift, end = p["ref_s"] - p["s"], p["s"] + p["m"] + width - 1
        if last and last["ref_doc"] == p["ref_doc"] and last["ref_start"] - last["start"] == shift and (
            p["s"] <= last["start"] + last["length"] - width + 1
        ):
            last["length"] = max(last["length"], end - last["start"])
        else:
            out.append({"start": p["s"], "length": end - p["s"], "ref_doc": p["ref_doc"], "ref_start": p["ref_s"]})
    return out


def remove_known(docs: DataFrame, width: int = 13, gram: int | None = None) -> DataFrame:
    """One row per document: word counts, ``factors`` found in earlier documents, and the words that stay as ``kept``."""
    found = W.per_document(phrases(docs, width, gram), PHRASE, "found")
    text = W.packed(W.keyed(docs)).join(found, list(W.KEY), "left")

    def cut(batches):
        for b in W.unpacked(batches):
            out = {k: [] for k in ("n_words", "n_removed", "factors", "kept", "kept_sha256")}
            for t, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist()):
                tokens, known = t.encode().split(), factors(found or [], width)
                removed = 0
                if known:
                    lo = np.array([f["start"] for f in known])
                    gone = N.covered(lo, lo + np.array([f["length"] for f in known]), len(tokens))
                    removed = int(gone.sum())
                kept = b" ".join(w for w, g in zip(tokens, gone) if not g) if removed else b" ".join(tokens)
                out["n_words"].append(len(tokens))
                out["n_removed"].append(removed)
                out["factors"].append(known)
                out["kept"].append(kept.decode())
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            item = pa.struct([(k, pa.int64()) for k in ("start", "length", "ref_doc", "ref_start")])
            kinds = (pa.int64(), pa.int64(), pa.list_(item), pa.string(), pa.string())
            arrays = [b.column("doc_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *out])

    return text.select("doc_id", "packed", "found").mapInArrow(
        cut, f"doc_id long, n_words long, n_removed long, factors {FACTOR}, kept string, kept_sha256 string"
    )
