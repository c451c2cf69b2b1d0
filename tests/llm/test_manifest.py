"""The manifest against trees hashed level by level, and places in the log against a log written one node at a time."""

import hashlib
import zlib

import numpy as np

from bilatera.llm import manifest as M

from .fixtures import SCHEMA, corpus, frame


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row[0], row[3], row[2], row[4], text]
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def tree(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([H(*at[k : k + 3]) for k in range(0, len(at), 3)])
    return levels


def way(levels, i):
    out = []
    for at in levels[:-1]:
        first = i // 3 * 3
        out.append((at[first:i], at[i + 1 : first + 3]))
        i //= 3
    return out


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in sources:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in rows if r[3] == s), key=lambda x: x[:3])
        own[s] = mine, tree([x[2] for x in mine])
    top = tree([own[s][1][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        mine, levels = own[s]
        for i, (_, _, node, r) in enumerate(mine):
            path = way(levels, i) + way(top, j)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf(r, r[1].replace("\n", "")) if even and r[1] is not None else node
            for left, right in path:
                folded = H(*left, folded, *right)
            proof = H(*[x for left, right in path for x in (*left, *right)])
            out.append((r[0], node, levels[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(spark, rows, **more):
    got = M.without_line_breaks(frame(spark, rows)).select(*COLUMNS) if not more else M.manifest(
        frame(spark, rows), tampered=more.pop("tampered"), text=more.pop("text"), **more).select(*COLUMNS)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(brute(rows), key=key)


def test_whole_corpus(spark):
    rows = corpus() + [(7, "a\nb", None, None, None, 1, "k", 0, "x", 9), (8, "ü\n", "é", "é", 2, 1, "k", 0, "x", 9), (9, None, None, "", None, 1, "k", 0, "x", 9)]
    check(spark, rows)


def test_one_row_and_none(spark):
    check(spark, [(4, "one\nline", "en", None, 8, 1, "k", 0, "x", 9)])
    got = M.without_line_breaks(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns[0] == "doc_id"


def test_many_storeys_and_equal_rows(spark):
    """Builders of nine leaves: four storeys; a source with half of all rows, copies of one row, and many sources of one row."""
    from pyspark.sql import functions as F

    rows = [(i, f"t{i}\nx", "en", "big", i, 1, "k", 0, "x", 9) for i in range(700)]
    rows += [(5, "same\n", "en", "copies", 1, 1, "k", 0, "x", 9)] * 130
    rows += [(i, "s", "de", f"s{i}", 1, 1, "k", 0, "x", 9) for i in range(100)]
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    check(spark, rows, tampered=even, text=F.translate("text", "\n", ""), levels=2)


def test_places_in_the_log():
    for n in [1, 2, 3, 4, 5, 8, 9, 10, 26, 27, 28, 80, 81, 100]:
        leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
        top = M.height(n)
        log = M.build(leaves, top)
        levels = tree([x.hex() for x in leaves])
        assert len(log) == 32 * sum(map(len, levels)) and log[-32:].hex() == levels[-1][0]
        for level, nodes in enumerate(levels):
            at = M.place(np.arange(len(nodes)) * 3**level, level, n, top)
            assert [log[32 * p : 32 * p + 32].hex() for p in at] == nodes
            assert level == 0 or (np.diff(at) > 0).all()


def test_tampering_is_found_everywhere(spark):
    """One changed row per run: its own proof breaks, all others hold."""
    from pyspark.sql import functions as F

    rows = [(i, f"text {i}", "en", f"s{i % 3}", i, 1, "k", 0, "x", 9) for i in range(90)]
    got = M.manifest(frame(spark, rows), tampered=F.col("doc_id") == 44, text=F.lit("other")).collect()
    assert [r["doc_id"] for r in got if not r["verified"]] == [44]
