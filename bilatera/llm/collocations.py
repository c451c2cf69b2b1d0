"""Phrases whose words come together more often than apart, counted in truncated suffix trees of word prefixes.

Texts are cut at punctuation into pieces and those into words; the suffix of a place is its next ``DEPTH`` words at most,
within its piece. All suffixes of a language form a tree of which a node is a phrase and its count the sum over the leaves
below it. The tree is never built as one:

* Prefixes are counted level by level, and only nodes under frequent prefixes are followed: a phrase occurs at most as often as its
  words and its pairs. Words and pairs are counted exactly, summed in the tasks first. The frequent ones reach the
  tasks as a bit filter of bounded size, which lets more through when it is full; counts decide later.
* Prefixes of two words in order are cut into groups of at most ``BUDGET`` suffixes. A pair that exceeds the budget is
  replaced by its prefixes of three words, counted in a pass of their own; one of three words that exceeds it, by equal
  ranges of the fourth word. A group is a range of prefixes, so the tasks need the groups' first prefixes only: 32 bytes for
  each ``BUDGET`` suffixes of the corpus.
* Suffixes, equal ones of a task summed, are shuffled by group. Each group sorts its own, which lays its subtrees out in
  order; the nodes of every depth are runs of neighbours and their counts sums over the leaves of a run. Nodes
  that a border cuts are added up at the end.

Words are 64-bit hashes that hold the language too, and phrases are tuples of them; the words themselves come from the table of
frequent words. Groups are bounded whatever phrase repeats: a group of one suffix has one row from each task.

A phrase of 2 to ``DEPTH`` words that occurs ``LEAST`` times is a candidate. Each of its cuts has the score floor(2000000 a / (l + r)) of
its count and the counts of both parts; the lowest counts, ties to the shortest first part. Candidates of which a longer candidate
that contains them occurs at least 80 % as often are dropped. Each language returns its first ``TOP``, by score, count and words in byte order.

Null text is empty, null lang is ``und``; extra columns are ignored; repeated rows count as often as they come. A language without
candidates has no rows, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage
from . import numeric as N
from . import windows as W

DEPTH = 4
LEAST = 30
TOP = 2000
#: A contained phrase goes if a longer one has this share of its count, in per cent.
COVERED = 80
#: Suffixes of one group.
BUDGET = 1 << 18
#: What ends a piece, as bytes.
ENDS = b".,;:!?\n\x0b\x0c\r"
H = [f"h{i}" for i in range(1, DEPTH + 1)]

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[list(ENDS)] = 0x20
_IS_END = np.isin(np.arange(256), list(ENDS))


def source(docs: DataFrame) -> DataFrame:
    """text, lang, and a hash of the language."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("lh"))


class Words:
    """Words of a batch: bytes, places, hashes and number of the piece."""

    def __init__(self, b: pa.RecordBatch):
        raw, offsets = N.flat(b.column("text"))
        self.data = _FOLD[raw]
        self.starts, self.ends, firsts = N.words(self.data, offsets)
        row = np.repeat(np.arange(b.num_rows), np.diff(firsts))
        lang = np.asarray(b.column("lh").to_numpy(zero_copy_only=False)).view(N.U)
        h = N.mix(N.word_values(self.data, self.starts, self.ends) + lang[row])
        self.h = N.signed(np.where(h == 0, N.U(1), h))
        self.row = row
        # A piece ends with its text or at one of the marks.
        ends = np.concatenate([[0], np.cumsum(_IS_END[raw])])
        self.piece = ends[self.starts] + row

    def next(self) -> np.ndarray:
        """Whether the following word is in the same piece."""
        return self.piece[1:] == self.piece[:-1]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return N.signed(N.mix(a.view(N.U) * N.U(0x9E3779B97F4A7C15) + b.view(N.U)))


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows added up, in order."""
    if not len(counts):
        return columns, counts
    sort = np.lexsort(columns[::-1])
    columns, counts = [c[sort] for c in columns], counts[sort]
    new = np.ones(len(counts), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts, first)


class Sums:
    """Rows of a task with their counts, added up whenever they fill ``limit``; what does not shrink is handed on."""

    def __init__(self, names: list[str], limit: int = 1 << 20):
        self.names, self.limit, self.parts, self.size = names, limit, [], 0

    def add(self, columns: list[np.ndarray], counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.parts.append(summed(columns, np.ones(len(columns[0]), np.int64) if counts is None else counts))
        self.size += len(self.parts[-1][1])
        if self.size > self.limit:
            columns, counts = self._merge()
            if 2 * len(counts) > self.limit:
                yield self._batch(columns, counts)
            else:
                self.parts, self.size = [(columns, counts)], len(counts)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield self._batch(*self._merge())

    def _merge(self):
        parts, self.parts, self.size = self.parts, [], 0
        return summed([np.concatenate(x) for x in zip(*[p[0] for p in parts])], np.concatenate([p[1] for p in parts]))

    def _batch(self, columns, counts) -> pa.RecordBatch:
        return W.table({**dict(zip(self.names, columns)), "c": counts})


def count_words(text: DataFrame) -> DataFrame:
    """(h, lang, word, c); a row without word holds the language's number of words under its hash of nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        totals: dict[str, int] = {}
        for b in N.slices(batches, "text", 1 << 20):
            w = Words(b)
            langs = b.column("lang").to_pylist()
            for r, c in enumerate(np.bincount(w.row, minlength=b.num_rows).tolist()):
                totals[langs[r]] = totals.get(langs[r], 0) + c
            keys, first, counts = np.unique(w.h, return_index=True, return_counts=True)
            raw = w.data.tobytes()
            for key, at, c in zip(keys.tolist(), first.tolist(), counts.tolist()):
                if key in known:
                    known[key][2] += c
                else:
                    known[key] = [raw[w.starts[at] : w.ends[at]], langs[w.row[at]], c]
            if len(known) > 1 << 17:
                yield batch(known)
                known = {}
        if known:
            yield batch(known)
        if totals:
            yield W.table({"h": pa.array([0] * len(totals), pa.int64()), "lang": list(totals), "word": pa.nulls(len(totals), pa.string()), "c": list(totals.values())})

    def batch(known: dict[int, list]) -> pa.RecordBatch:
        word, lang, c = zip(*known.values())
        return W.table({"h": list(known), "lang": pa.array(lang, pa.string()), "word": [x.decode() for x in word], "c": list(c)})

    found = text.mapInArrow(run, "h long, lang string, word string, c long")
    return found.groupBy("h", "lang", "word").agg(F.sum("c").alias("c"))


def count_pairs(text: DataFrame, words) -> DataFrame:
    """(h1, h2, c) of neighbouring words that both pass the filter."""

    def run(batches):
        sums = Sums(H[:2])
        for b in N.slices(batches, "text", 1 << 20):
            w = Words(b)
            good = words(w.h.view(N.U))
            at = np.flatnonzero(w.next() & good[1:] & good[:-1])
            yield from sums.add([w.h[at], w.h[at + 1]])
        yield from sums.rest()

    return text.select("text", "lh").mapInArrow(run, "h1 long, h2 long, c long").groupBy("h1", "h2").agg(F.sum("c").alias("c"))


def _suffixes(w: Words, pairs) -> list[np.ndarray]:
    """Suffixes of at least two words along pairs that pass the filter; zero stands for what is cut off."""
    follows = np.zeros(len(w.h), bool)
    at = np.flatnonzero(w.next())
    follows[at] = pairs(_pair(w.h[at], w.h[at + 1]).view(N.U))
    at = np.flatnonzero(follows)
    columns, go = [w.h[at]], np.ones(len(at), bool)
    for k in range(1, DEPTH):
        go = go & follows[np.minimum(at + k - 1, len(follows) - 1)]
        columns.append(np.where(go, w.h[np.minimum(at + k, len(w.h) - 1)], 0))
    return columns


def _among(columns: list[np.ndarray], sorted_rows: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted rows are at most each given one, columns compared in turn."""
    lo, hi = np.zeros(len(columns[0]), np.int64), np.full(len(columns[0]), len(sorted_rows[0]))
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = np.where(open_, (lo + hi) // 2, 0)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for have, want in zip(sorted_rows, columns):
            x = have[mid]
            less |= same & (x < want)
            same &= x == want
        low = open_ & (less | same)
        lo, hi = np.where(low, mid + 1, lo), np.where(open_ & ~low, mid, hi)


def count_triples(text: DataFrame, pairs, hot: list[np.ndarray]) -> DataFrame:
    """(h1, h2, h3, c) of the suffixes under given pairs."""
    sent = text.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        sums, hot = Sums(H[:3]), sent.value
        for b in N.slices(batches, "text", 1 << 20):
            found = _suffixes(Words(b), pairs)
            if len(found[0]):
                k = np.maximum(_among(found[:2], hot) - 1, 0)
                keep = (hot[0][k] == found[0]) & (hot[1][k] == found[1])
                yield from sums.add([c[keep] for c in found[:3]])
        yield from sums.rest()

    return text.select("text", "lh").mapInArrow(run, "h1 long, h2 long, h3 long, c long").groupBy(*H[:3]).agg(F.sum("c").alias("c"))


def cut_groups(prefixes: DataFrame, budget: int) -> list[np.ndarray]:
    """First prefixes of groups of at most ``budget`` suffixes: a range shuffle orders the prefixes, tasks cut their part."""

    def run(batches):
        total, first = 0, True
        for b in batches:
            cols = [b.column(h).to_numpy() for h in H]
            take = []
            for i, c in enumerate(b.column("c").to_pylist()):
                total += c
                if first or total > budget:
                    take.append(i)
                    total, first = c, False
            if take:
                yield W.table({h: c[take] for h, c in zip(H, cols)})

    dealt = prefixes.repartitionByRange(*H).sortWithinPartitions(*H)
    # As many rows as the corpus has budgets, and one for each task.
    rows = dealt.mapInArrow(run, ", ".join(f"{h} long" for h in H)).toArrow()
    cols = [rows.column(h).to_numpy() for h in H]
    sort = np.lexsort(cols[::-1])
    return [c[sort] for c in cols]


def vertical_partitions(text: DataFrame, pairs: DataFrame, filter_, budget: int) -> list[np.ndarray]:
    """First prefixes of the groups, from the exact counts of prefixes of two words and, below frequent ones, three."""
    low = F.lit(-(1 << 63))
    over = F.col("c") > budget
    prefixes = pairs.where(~over).select("h1", "h2", low.alias("h3"), low.alias("h4"), "c")
    hot = pairs.where(over).select("h1", "h2").orderBy("h1", "h2").toArrow()  # at most one for each budget of suffixes
    if hot.num_rows:
        below = count_triples(text, filter_, [hot.column(h).to_numpy() for h in H[:2]])
        parts = F.ceil(F.col("c") / budget)
        # A fourth word's hash is anywhere in 64 bits, so equal ranges hold like shares, but for suffixes that repeat, which are few rows.
        starts = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.floor((k / parts - 0.5) * 2.0**64))
        deeper = below.select("h1", "h2", "h3", F.explode(F.when(over, starts).otherwise(F.array(low))).alias("h4"), F.ceil(F.col("c") / parts).alias("c"))
        prefixes = prefixes.unionByName(deeper)
    return cut_groups(prefixes, budget)


def group_suffixes(text: DataFrame, pairs, groups: list[np.ndarray]) -> DataFrame:
    """(g, h1 ... , c): suffixes of every task, equal ones summed, with their group."""
    sent = text.sparkSession.sparkContext.broadcast(groups)

    def run(batches):
        sums = Sums(H)
        for b in N.slices(batches, "text", 1 << 20):
            for out in sums.add(_suffixes(Words(b), pairs)):
                yield placed(out)
        for out in sums.rest():
            yield placed(out)

    def placed(b: pa.RecordBatch) -> pa.RecordBatch:
        g = _among([b.column(h).to_numpy() for h in H], sent.value)
        return W.table({"g": g.astype(np.int64), **{n: b.column(n) for n in b.schema.names}})

    return text.select("text", "lh").mapInArrow(run, f"g long, {', '.join(f'{h} long' for h in H)}, c long")


def subtree_counts(suffixes: DataFrame, least: int) -> DataFrame:
    """(h1 ..., c): nodes of two words and more, from the subtrees of every group."""

    def step(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cols, c = summed([rows.column(n).to_numpy() for n in ("g", *H)], rows.column("c").to_numpy())
        g, cols = cols[0], cols[1:]
        edge = np.concatenate([[True], g[1:] != g[:-1], [True]])
        for depth in range(2, DEPTH + 1):
            new = np.ones(len(g), bool)
            new[1:] = edge[1:-1] | np.any([x[1:] != x[:-1] for x in cols[:depth]], axis=0)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(g)) - 1
            total = np.add.reduceat(c, first)
            # A node at a group's edge may go on in the next group.
            keep = (cols[depth - 1][first] != 0) & ((total >= least) | edge[:-1][first] | edge[1:][last])
            at = first[keep]
            yield W.table({**{h: x[at] if k < depth else np.zeros(len(at), np.int64) for k, (h, x) in enumerate(zip(H, cols))}, "c": total[keep]})

    dealt = suffixes.repartition("g").sortWithinPartitions("g")
    found = dealt.mapInArrow(W.by_groups(step, ["g"], 1 << 23), f"{', '.join(f'{h} long' for h in H)}, c long")
    return found.groupBy(*H).agg(F.sum("c").alias("c")).where(F.col("c") >= least)


def count_phrases(docs: DataFrame, *, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Words and numbers of words by language, and counts of all phrases of 2 to ``DEPTH`` words that occur ``least`` times."""
    text = source(docs)
    words = cut_lineage(count_words(text).where(F.col("word").isNull() | (F.col("c") >= least)))
    known = W.BitFilter(words.where("word is not null").select("h"), "h")
    counted = cut_lineage(count_pairs(text, known).where(F.col("c") >= least))
    pairs = W.BitFilter(_with_key(counted), "k")
    groups = vertical_partitions(text, counted, pairs, budget)
    phrases = subtree_counts(group_suffixes(text, pairs, groups), least) if len(groups[0]) else counted.select(
        "h1", "h2", F.lit(0).cast("long").alias("h3"), F.lit(0).cast("long").alias("h4"), "c")
    return words, cut_lineage(phrases)


def _with_key(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield W.table({"k": _pair(b.column("h1").to_numpy(), b.column("h2").to_numpy())})

    return pairs.select("h1", "h2").mapInArrow(run, "k long")


def _part(row: list[Column], first: int, n: int) -> list[Column]:
    """The phrase of ``n`` words from ``first`` on."""
    return [row[first + k] if k < n else F.lit(0).cast("long") for k in range(DEPTH)]


def mine(docs: DataFrame, *, least: int = LEAST, top: int = TOP, covered: int = COVERED, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of every language."""
    words, phrases = count_phrases(docs, least=least, budget=budget)
    named = words.where("word is not null")
    zero = F.lit(0).cast("long")
    every = named.select(F.col("h").alias("h1"), zero.alias("h2"), zero.alias("h3"), zero.alias("h4"), "c").unionByName(phrases)
    row = [F.col(h) for h in H]
    size = sum((h != 0).cast("int") for h in row)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    # Longest containing phrase by count: every phrase tells its parts.
    inner = F.array(*[
        F.struct(((size > n) & (row[s + n - 1] != 0)).alias("there"), *[x.alias(f"p{k}") for k, x in enumerate(_part(row, s, n), 1)])
        for n in range(2, DEPTH) for s in range(DEPTH - n + 1)
    ])
    told = phrases.where(row[2] != 0).select("c", F.inline(F.filter(inner, lambda s: s["there"])))
    told = told.groupBy("p1", "p2", "p3", "p4").agg(F.max("c").alias("longer")).select(*[F.col(f"p{k}").alias(h) for k, h in enumerate(H, 1)], "longer")
    left = phrases.join(told, H, "left").where(
        F.col("longer").isNull() | (big("longer") * 100 < F.col("c").cast("decimal(20,0)") * covered)
    ).select(*H, F.col("c").alias("a"), size.alias("size"))
    cuts = F.array(*[
        F.struct(
            F.lit(k).alias("k"), F.struct(*[x.alias(h) for h, x in zip(H, _part(row, 0, k))]).alias("head"),
            F.struct(*[(row[k + j] if k + j < DEPTH else zero).alias(h) for j, h in enumerate(H)]).alias("tail"),
        ) for k in range(1, DEPTH)
    ])
    each = left.select(*H, "a", F.inline(F.filter(cuts, lambda s: s["k"] < F.col("size"))))
    known = every.select(F.struct(*H).alias("part"), "c")
    each = each.join(known.select(F.col("part").alias("head"), F.col("c").alias("l")), "head").join(
        known.select(F.col("part").alias("tail"), F.col("c").alias("r")), "tail"
    )
    # div on decimals is exact, and the quotient is two million at most.
    each = each.withColumn("score", F.expr("cast(2000000 * cast(a as decimal(20,0)) as decimal(38,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = each.groupBy(*H, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select(*H, "a", "b.score", "b.l", "b.r")
    first = named.select(F.col("h").alias("h1"), "lang", F.col("word").alias("w1"))
    ranked = best.join(first, "h1").withColumn("_r", F.rank().over(Over.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))))
    few = ranked.where(F.col("_r") <= top)  # ties too; their words decide
    for k in range(2, DEPTH + 1):
        few = few.join(named.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}")), f"h{k}", "left")
    few = few.withColumn("phrase", F.concat_ws(" ", *[f"w{k}" for k in range(1, DEPTH + 1)]))
    totals = words.where("word is null").groupBy("lang").agg(F.sum("c").alias("n"))
    order = Over.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = few.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
