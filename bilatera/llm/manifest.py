"""Merkle manifest of a dataset: trees of runs of three per source and one tree over the sources, with proofs.

The digest of a row is its leaf. Leaves of a source ascend by doc_id; runs of ``ARITY`` neighbours are hashed level by level
until one node remains, the subroot. Subroots in order of their source are hashed likewise to the root.

Nodes are appended to a log in the order in which they are completed (postorder). Builders are aligned: each takes
``ARITY ** HEIGHT`` neighbouring leaves, whose nodes are a stretch of that log that depends on no other builder. The roots
of all builders of a tree are the leaves of the next storey, until one builder holds the tree. No pointers are
kept: the nodes of a level that are complete before leaf s are s // ARITY ** level, so the place of every node follows from
the sizes of subtrees alone (``place``). A proof reads the siblings of a leaf at these places in its builder's log, then
those of the builder in the storey above, up to the root.

Any number of rows may share a source: rows are put in order by a range shuffle, numbered within its partitions, and the
partitions' counts give the offsets. Nobody holds more than one builder's leaves, whatever the sizes of sources and of their number.

Null columns are hashed as ``-``; null doc_id comes first within its source, null source before all others. Rows with the same doc_id
are ordered by leaf, so equal rows are neighbours and interchangeable. Extra columns are ignored. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage
from . import windows as W

ARITY = 3
#: Levels that one builder completes; 3 ** 7 leaves are 2,187.
HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


def digest(*fields: Column) -> Column:
    """SHA-256 over the fields, each as byte count, colon and value, or ``-`` where it is null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(c.cast("string")) for c in fields]), 256))


def height(n: int, arity: int = ARITY) -> int:
    """Levels above ``n`` leaves until one node remains."""
    h = 0
    while n > 1:
        n, h = -(-n // arity), h + 1
    return h


def place(leaf: np.ndarray, level: int, n: int, top: int, arity: int = ARITY) -> np.ndarray:
    """Where the node of ``level`` that begins at each leaf stands in the log of a tree of ``n`` leaves and ``top`` levels.

    Before it come the nodes completed before its first leaf, and all of its own subtree.
    """
    size = np.minimum(arity**level, n - leaf)
    before = sum(leaf // arity**j for j in range(top + 1))
    return before + sum(-(-size // arity**j) for j in range(level + 1)) - 1


def build(leaves: list[bytes], top: int, arity: int = ARITY) -> bytes:
    """Log of a builder: all nodes up to level ``top`` in the order of their completion, digests one after the other."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(top + 1)]

    def append(level: int, node: bytes) -> None:
        log.append(node)
        if level < top:
            open_runs[level].append(node)
            if len(open_runs[level]) == arity:
                close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        append(level + 1, hashlib.sha256("".join([x.hex() for x in run]).encode()).digest())

    for leaf in leaves:
        append(0, leaf)
    for level in range(top):  # the last run of a level may be shorter
        if open_runs[level]:
            close(level)
    return b"".join(log)


def siblings(log: bytes, n: int, top: int, arity: int = ARITY) -> list[list[tuple[bytes, bytes]]]:
    """For every leaf and level the digests left and right of its node within its run, as hexadecimal text."""
    text = log.hex().encode()
    out: list[list[tuple[bytes, bytes]]] = [[] for _ in range(n)]
    leaf = np.arange(n)
    for level in range(top):
        count = -(-n // arity**level)
        starts = np.arange(count) * arity**level
        at = place(starts, level, n, top, arity)
        nodes = [text[2 * DIGEST * p : 2 * DIGEST * (p + 1)] for p in at.tolist()]
        pairs = []
        for a in range(count):
            first = a // arity * arity
            pairs.append((b"".join(nodes[first:a]), b"".join(nodes[a + 1 : first + arity])))
        for i, a in enumerate((leaf // arity**level).tolist()):
            out[i].append(pairs[a])
    return out


def in_order(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with their position ``i`` within their tree and the tree's number of rows ``n``.

    A range shuffle brings them in order; rows that are equal are told apart by where they were read, so any number of them is dealt out too.
    """
    keys = [tree, *order, "_read"]
    dealt = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(dealt.drop("_read").withColumns({"_part": F.spark_partition_id(), "_at": at}))
    counts = placed.groupBy("_part", tree).agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    # One row for each partition that holds some of a tree.
    whole = Over.partitionBy(tree)
    offsets = counts.select(
        "_part", tree, "_first", F.sum("_c").over(whole).alias("n"),
        (F.sum("_c").over(whole.orderBy("_part").rowsBetween(Over.unboundedPreceding, 0)) - F.col("_c")).alias("_before"),
    )
    return placed.join(offsets, ["_part", tree]).withColumn("i", F.col("_before") + F.col("_at") - F.col("_first")).drop(
        "_part", "_at", "_first", "_before"
    )


def _columns(b: pa.RecordBatch, *names: str) -> list[list]:
    return [b.column(n).to_pylist() for n in names]


def build_storey(rows: DataFrame, tree: str, *carried: str, levels: int = HEIGHT) -> DataFrame:
    """One row per builder: tree, its number ``b`` there, ``n`` builders of the tree, ``top``, the log, and the carried values of its leaves in order."""
    size = ARITY**levels
    grouped = rows.withColumn("b", F.floor(F.col("i") / size).cast("long")).groupBy(tree, "b").agg(
        F.max("n").alias("leaves"), F.sort_array(F.collect_list(F.struct("i", "digest", *carried))).alias("each")
    )
    grouped = grouped.select(
        tree, "b", "leaves", F.col("each.digest").alias("digests"), *[F.col(f"each.{c}").alias(c) for c in carried]
    )
    kept = [f"{c} {grouped.schema[c].dataType.simpleString()}" for c in (tree, *carried)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                number, leaves = row.column("b")[0].as_py(), row.column("leaves")[0].as_py()
                digests = row.column("digests")[0].as_py()
                top = levels if leaves > size else height(leaves)
                log = build(digests, top)
                yield W.table({
                    **{c: row.column(c) for c in (tree, *carried)}, "b": [number], "n": [-(-leaves // size)], "m": [len(digests)],
                    "top": pa.array([top], pa.int32()), "log": [log], "digest": [log[-DIGEST:]],
                })

    return cut_lineage(grouped.mapInArrow(run, f"{', '.join(kept)}, b long, n long, m long, top int, log binary, digest binary"))


def build_tree(leaves: DataFrame, tree: str, *carried: str, levels: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """Storeys of builders from the leaves up, and one row (tree, digest) for every tree. ``leaves`` has tree, i, n, digest."""
    storeys = [build_storey(leaves, tree, *carried, levels=levels)]
    while (storeys[-1].agg(F.max("n")).first()[0] or 0) > 1:
        above = storeys[-1].select(tree, F.col("b").alias("i"), "n", "digest")
        storeys.append(build_storey(above, tree, levels=levels))
    return storeys, storeys[-1].select(tree, "digest")


def pack_path(path: list[tuple[bytes, bytes]]) -> bytes:
    """Levels as text: the digests left of the node, a comma, those right of it, a semicolon."""
    return b"".join(b"%b,%b;" % x for x in path)


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root (as hexadecimal text) that a leaf and the siblings of its path give."""
    node = leaf.hex().encode()
    for level in path.split(b";")[:-1]:
        left, right = level.split(b",")
        node = hashlib.sha256(left + node + right).hexdigest().encode()
    return node


def proof_digest(path: bytes) -> str:
    return hashlib.sha256(path.replace(b",", b"").replace(b";", b"")).hexdigest()


def child_paths(storey: DataFrame, tree: str, *carried: str) -> DataFrame:
    """(tree, i, path, carried values): siblings of every leaf of a storey up to the root, from those of its builder in ``path``."""
    names = [tree, *carried]
    kinds = ", ".join(f"{c} {storey.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*_columns(b, "b", "m", "top", "log", "path"))
            for k, (number, m, top, log, path) in enumerate(rows):
                first = number * ARITY**top
                same = pa.array(np.full(m, k))
                yield W.table({
                    **{c: b.column(c).take(same) for c in names}, "i": np.arange(first, first + m),
                    "path": [pack_path(p) + path for p in siblings(log, m, top)],
                })

    return storey.select(*names, "b", "m", "top", "log", "path").mapInArrow(run, f"{kinds}, i long, path binary")


def descend(storeys: list[DataFrame], tree: str, paths: DataFrame, *carried: str) -> DataFrame:
    """The lowest storey with ``path`` (the builder's siblings up to the root), from the paths of whole trees; what they carry goes along."""
    found = storeys[-1].join(paths, tree)
    for below in reversed(storeys[:-1]):
        above = cut_lineage(child_paths(found, tree, *carried)).withColumnRenamed("i", "b")
        found = below.join(above, [tree, "b"])
    return found


def leaves_of(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """Leaf and source of every row; ``changed`` is the leaf with ``text`` instead, where ``tampered`` holds, else null."""
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    fields = [doc_id, *[F.col(c) for c in FIELDS[1:-1]]]
    changed = F.lit(None).cast("binary") if tampered is None else F.when(tampered, digest(*fields, text))
    # Sources are told from null by a first character that keeps their order.
    tree = F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))
    return docs.select(doc_id.alias("doc_id"), tree.alias("tree"), digest(*fields, F.col("text")).alias("digest"), changed.alias("changed"))


def manifest(docs: DataFrame, *, tampered: Column | None = None, text: Column | None = None, levels: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row; source beside them.

    Digests are lowercase hexadecimal. ``proof_sha256`` is the digest of all siblings on the way to the root, level by level, left
    to right. ``folded_root`` is computed from the leaf, or from the leaf with ``text`` where ``tampered`` holds, and the siblings.
    """
    rows = in_order(leaves_of(docs, tampered, text), "tree", ["doc_id", "digest"])
    storeys, subroots = build_tree(rows, "tree", "doc_id", "changed", levels=levels)
    named = cut_lineage(in_order(subroots.withColumn("all", F.lit("all")), "all", ["tree"]))
    upper, roots = build_tree(named, "all", levels=levels)
    none = F.lit(b"")
    top = child_paths(descend(upper, "all", roots.select("all", none.alias("path"))), "all")
    # One row for each source: its path from subroot to root.
    above = named.join(top, ["all", "i"]).join(F.broadcast(roots.select("all", F.col("digest").alias("root"))), "all")
    paths = cut_lineage(above.select("tree", "path", F.col("digest").alias("subroot"), "root"))
    lowest = descend(storeys, "tree", paths, "subroot", "root")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                source, m, t, log, rest, subroot, root = (x[0] for x in _columns(row, "tree", "m", "top", "log", "path", "subroot", "root"))
                ids, changed = (x[0] for x in _columns(row, "doc_id", "changed"))
                at = place(np.arange(m), 0, m, t).tolist()
                out: dict[str, list] = {"leaf": [], "proof_sha256": [], "folded_root": []}
                for i, p in enumerate(siblings(log, m, t)):
                    leaf, full = log[DIGEST * at[i] : DIGEST * (at[i] + 1)], pack_path(p) + rest
                    out["leaf"].append(leaf.hex())
                    out["proof_sha256"].append(proof_digest(full))
                    out["folded_root"].append(fold(changed[i] or leaf, full).decode())
                yield W.table({
                    "doc_id": pa.array(ids, pa.int64()), "source": pa.array([source[1:] if source[0] == "1" else None] * m, pa.string()),
                    "leaf": out["leaf"], "subroot": [subroot.hex()] * m, "root": [root.hex()] * m, "proof_sha256": out["proof_sha256"],
                    "folded_root": out["folded_root"], "verified": [x == root.hex() for x in out["folded_root"]],
                })

    return lowest.mapInArrow(
        prove, "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


def without_line_breaks(docs: DataFrame) -> DataFrame:
    """The manifest checked against rows of which those with an even CRC of the id have lost the line breaks of their text."""
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, tampered=F.coalesce(even, F.lit(False)), text=F.translate("text", "\n", ""))
