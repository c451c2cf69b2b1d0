"""Line dedup by an exact set-similarity join.

A line is its set of tokens, by default its words, which finds lines that differ by a word anywhere. With a larger ``width`` tokens are
shingles of so many words, and a shorter line is one token. Tokens are ordered by rarity: counts of
all tokens go into a table of a fixed number of cells, and tokens are ordered by their cell's logarithm, then by hash. Two
lines of Jaccard similarity ``threshold`` or more share a token within their first n - ceil(threshold n) + 1 (the prefix), and
at the first token they share, lengths and positions leave enough tokens to share. Only lines with a prefix token that
another set has too are candidates; those joined by such tokens are compared in blocks (see ``candidates``): length,
prefix and positional filters first, then the whole sets. Single words connect nearly all lines, so they are compared token
by token instead (see ``_word_pairs``).

A line goes when an earlier line (by doc_id, then line number; no doc_id comes last) is that similar, whether that
one stays or not. Equal sets are one class with its first place.

Lines without words always stay and are never a reason. Null text has no lines. Rows equal in id and text are
treated alike. Extra columns are kept by ``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage
from . import candidates as C
from . import numeric as N
from . import windows as W

THRESHOLD, WIDTH = 0.8, 1
CELL_BITS, CHUNKS = 20, 64
PLACE = ("no_id", "doc_id", "ka", "kb", "line")
BREAK = 0x0A
#: For single words: 64-bit words of a set's mark, lines of a token in a block, and pairs compared at once.
MARK, BLOCK, PAIRS = 4, 1024, 1 << 19


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of all rows, line breaks at their ends, and the row of each."""
    breaks = np.flatnonzero(data == BREAK) + 1
    inside = breaks[~np.isin(breaks, offsets[1:])] if len(breaks) else breaks
    # A break at the very end of a row opens one more, empty line; it has no words.
    cuts = np.unique(np.concatenate([offsets, inside]))
    return cuts, np.searchsorted(offsets, cuts[:-1], side="right") - 1


def tokens(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all lines that have words, their offsets, and the line of each."""
    starts, ends, firsts = N.words(data, offsets)
    values, count = N.word_values(data, starts, ends), np.diff(firsts)
    have = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at, line = N.spread(firsts[:-1], have), np.repeat(np.arange(len(count)), have)
    h = N.Ranges(values)(at, np.minimum(at + width, firsts[1:][line]))
    full = np.flatnonzero(have)
    return h, np.concatenate([[0], np.cumsum(have[full])]), full


def rarity_levels(text: DataFrame, width: int = WIDTH) -> np.ndarray:
    """For every cell of token hashes, the logarithm of how often its tokens occur."""

    def count(batches):
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for b in N.slices(batches, "text"):
            data, offsets = N.flat(b.column("text"))
            h, _, _ = tokens(data, lines_of(data, offsets)[0], width)
            cells += np.bincount((h >> N.U(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
        parts = cells.reshape(CHUNKS, -1)
        yield W.table({"chunk": np.arange(CHUNKS), "n": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, n in zip(b.column("chunk").to_pylist(), b.column("n").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(n, np.int64)
        for chunk, n in sums.items():
            level = np.floor(2 * np.log2(np.maximum(n, 1))).astype(np.uint8)
            yield W.table({"chunk": np.array([chunk]), "n": pa.array([level.tobytes()], pa.binary())})

    # A fixed number of cells: every task sends one table of counts, a byte per cell comes back.
    got = text.select("text").mapInArrow(count, "chunk long, n binary").repartition("chunk").mapInArrow(add, "chunk long, n binary").collect()
    levels = np.zeros((CHUNKS, (1 << CELL_BITS) // CHUNKS), np.uint8)
    for r in got:
        levels[r["chunk"]] = np.frombuffer(r["n"], np.uint8)
    return levels.ravel()


def ordered(h: np.ndarray, offsets: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of every line in order of rarity: the level in the high byte, hash bits below."""
    line = N.owners(offsets)
    number = (levels[h >> N.U(64 - CELL_BITS)].astype(N.U) << N.U(56)) | (h & N.U((1 << 56) - 1))
    order = np.lexsort((number, line))
    number, line = number[order], line[order]
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (line[1:] != line[:-1])
    return number[new], np.concatenate([[0], np.cumsum(np.bincount(line[new], minlength=len(offsets) - 1))])


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1


def _sets(number: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every set."""
    at = offsets[:-1]
    return tuple(N.signed(N.mix(np.add.reduceat(N.mix(number ^ N.U(b)), at))) if len(at) else np.zeros(0, np.int64) for b in N.BASES)


def near(payloads: list, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of ordered sets reach the threshold; a payload is a place and the set."""
    sets = [np.frombuffer(p, N.U, offset=_PLACE_BYTES) for p in payloads]
    n = np.array([len(s) for s in sets])
    out = np.zeros(len(left), bool)
    alive = np.flatnonzero(np.minimum(n[left], n[right]) >= np.ceil(threshold * np.maximum(n[left], n[right]) - 1e-9))
    if not len(alive):
        return out
    # Tokens that the prefixes share, and at the first of them the places.
    p = prefix_length(n, threshold)
    i, j = left[alive], right[alive]
    offsets, everything = np.concatenate([[0], np.cumsum(n)]), np.concatenate(sets)
    for lo in range(0, len(alive), 20_000):
        l, r, some = i[lo : lo + 20_000], j[lo : lo + 20_000], alive[lo : lo + 20_000]
        pair = np.concatenate([np.repeat(np.arange(len(l)), p[l]), np.repeat(np.arange(len(r)), p[r])])
        at = np.concatenate([N.spread(np.zeros(len(l), np.int64), p[l]), N.spread(np.zeros(len(r), np.int64), p[r])])
        token = np.concatenate([everything[N.spread(offsets[l], p[l])], everything[N.spread(offsets[r], p[r])]])
        order = np.lexsort((token, pair))
        pair, at, token = pair[order], at[order], token[order]
        same = np.flatnonzero((pair[1:] == pair[:-1]) & (token[1:] == token[:-1]))
        first, where = np.unique(pair[same], return_index=True)
        same = same[where]
        a, b = at[same], at[same + 1]
        # Which of the two comes first in the sort is open: the bound takes the better assignment.
        best = np.maximum(np.minimum(n[l[first]] - a, n[r[first]] - b), np.minimum(n[l[first]] - b, n[r[first]] - a))
        enough = np.ceil((n[l[first]] + n[r[first]]) * (threshold / (1 + threshold)) - 1e-9)
        some = some[first[best >= enough]]
        if len(some):
            common = C.common_counts(sets, left[some], right[some])
            out[some] = common / (n[left[some]] + n[right[some]] - common) >= threshold
    return out


_PLACE_BYTES = 40


def place_bytes(no_id: np.ndarray, doc_id: np.ndarray, ka: np.ndarray, kb: np.ndarray, line: np.ndarray) -> list[bytes]:
    """Places as bytes that compare like them."""
    flip = np.int64(-(2**63))
    m = np.stack([no_id.astype(np.int64), doc_id ^ flip, ka ^ flip, kb ^ flip, line.astype(np.int64)], axis=1).astype(">i8")
    return [r.tobytes() for r in m]


def later(ids: np.ndarray, weight: np.ndarray, payloads: list, i: np.ndarray, j: np.ndarray):
    """The later line of every similar pair, once."""
    places = [bytes(memoryview(p)[:_PLACE_BYTES]) for p in payloads]
    for k in {a if places[a] > places[b] else b for a, b in zip(i.tolist(), j.tolist())}:
        yield int(ids[k]), None, 1


def _marks(number: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``MARK`` words of 64 bits for every set; each token flips one bit."""
    place = N.mix(number) >> N.U(64 - 6 - (MARK - 1).bit_length())
    bit = N.U(1) << (place & N.U(63))
    word = place >> N.U(6)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == N.U(k), bit, N.U(0)), offsets[:-1]) for k in range(MARK)], axis=1)


def _maybe_similar(rows: pa.Table, threshold: float):
    """Pairs of a token's lines, as places in ``rows``, that lengths and marks do not rule out.

    Of sets that reach the threshold so few tokens are not common, and each flips one bit at most.
    """
    key = [rows.column(c).to_numpy() for c in ("h", "lo", "hi")]
    new = np.ones(rows.num_rows, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
    own, n = rows.column("own").to_numpy(), rows.column("n").to_numpy().astype(np.int64)
    marks = np.stack([rows.column(f"m{k}").to_numpy().view(N.U) for k in range(MARK)], axis=1)
    at = np.arange(rows.num_rows)
    last = np.append(np.flatnonzero(new), rows.num_rows)[np.cumsum(new)]
    more = last - at - 1
    work, lo = np.concatenate([[0], np.cumsum(more)]), 0
    while lo < rows.num_rows:
        end = max(lo + 1, int(np.searchsorted(work, work[lo] + PAIRS, side="right")) - 1)
        i = np.repeat(at[lo:end], more[lo:end])
        j = N.spread(at[lo:end] + 1, more[lo:end])
        # Rows of two blocks meet across them only, those of one block with each other.
        keep = (key[1][i] == key[2][i]) | (own[i] != own[j])
        keep &= np.minimum(n[i], n[j]) >= np.ceil(threshold * np.maximum(n[i], n[j]) - 1e-9)
        i, j = i[keep], j[keep]
        total = n[i] + n[j]
        differ = total - 2 * np.ceil(total * (threshold / (1 + threshold)) - 1e-9)
        keep = np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64) <= differ
        yield i[keep], j[keep]
        lo = end


def _word_pairs(members: DataFrame, shared: DataFrame, known: W.BitFilter, threshold: float) -> DataFrame:
    """(s1, s2) of the members that have an earlier similar one.

    The lines of a prefix token are compared in blocks by length and mark, pairs that remain on their whole sets. Every line
    is first held against its earliest possible partner of each token, which settles groups of near copies in about as
    many pairs as lines; lines still open then against all others.
    """
    width = ", ".join(f"m{k} long" for k in range(MARK))

    def emit(batches):
        for b in N.slices(batches, "set"):
            data, offsets = N.flat(b.column("set"))
            number, firsts = np.frombuffer(data.tobytes(), N.U), offsets // 8
            n = np.diff(firsts)
            if not len(n):
                continue
            p = prefix_length(n, threshold)
            token, at = number[N.spread(firsts[:-1], p)], np.repeat(np.arange(b.num_rows), p)
            hit = known(token)
            token, at = token[hit], at[hit]
            marks, take = _marks(number, firsts), pa.array(at)
            yield W.table({"h": N.signed(token), **{c: b.column(c).take(take) for c in ("id", "d", "line")}, "n": n[at].astype(np.int32),
                           **{f"m{k}": N.signed(marks[at, k]) for k in range(MARK)}})

    numbered = members.select("id", F.coalesce("first.doc_id", F.lit((1 << 63) - 1)).alias("d"), "first.line", "set")
    rows = numbered.mapInArrow(emit, f"h long, id long, d long, line int, n int, {width}")
    # Counts are of lines, equal ones of different tasks included: blocks may be smaller than ``BLOCK``.
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    large = shared.where(F.col("c") > BLOCK).select("h", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    # At most a row for every ``BLOCK`` prefix tokens: sent to the tasks, it saves a shuffle of all lines' tokens.
    dealt = rows.join(F.broadcast(large), "h", "left").withColumn("own", F.pmod(F.xxhash64("id"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    keys = ["h", "lo", "hi"]
    dealt = dealt.select("h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "d", "line", "n",
                         *[f"m{k}" for k in range(MARK)])
    dealt = cut_lineage(dealt.repartition(*keys).sortWithinPartitions(*keys, "d", "line", "id"))

    def partners(only=None):
        def step(table: pa.Table):
            ids, d, line = (table.column(c).to_numpy() for c in ("id", "d", "line"))
            a, b = [np.concatenate(x) for x in zip((ids[:0].astype(np.int64),) * 2, *_maybe_similar(table, threshold))]
            # Rows are in order; where document and line are equal, which is earlier shows later.
            tie = (d[a] == d[b]) & (line[a] == line[b])
            early, late = np.concatenate([a, b[tie]]), np.concatenate([b, a[tie]])
            if only is None:
                order = np.lexsort((early, late))
                early, late = early[order], late[order]
                head = np.flatnonzero(np.append(True, late[1:] != late[:-1])) if len(late) else late
                others = np.diff(np.append(head, len(late))) - 1
                yield W.table({"a": ids[late[head]], "b": ids[early[head]], "others": others.astype(np.int64)})
            else:
                keep = only(ids[late].view(N.U))
                yield W.table({"a": ids[late[keep]], "b": ids[early[keep]], "others": np.zeros(int(keep.sum()), np.int64)})

        return dealt.mapInArrow(W.by_groups(step, keys, 1 << 23), "a long, b long, others long")

    def similar(pairs: DataFrame) -> DataFrame:
        """The members of column a whose partner is earlier and similar."""
        pairs = cut_lineage(pairs.select("a", "b").where("a <> b").distinct())
        asked = W.BitFilter(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct())

        def some(batches):
            for b in batches:
                yield b.filter(pa.array(asked(b.column("id").to_numpy().view(N.U))))

        sets = members.select("id", "first", "set").mapInArrow(some, members.select("id", "first", "set").schema)
        left, right = (sets.select(F.col("id").alias(k), F.col("first").alias(f"{k}_first"), F.col("set").alias(f"{k}_set")) for k in "ab")
        both = pairs.join(left, "a").join(right, "b").where("b_first < a_first").select("a", "a_set", "b_set")

        def verify(batches):
            for b in N.slices(batches, "a_set"):
                k = b.num_rows
                sets = [np.frombuffer(x, N.U) for c in ("a_set", "b_set") for x in b.column(c).to_pylist()]
                n, at = np.array([len(x) for x in sets]), np.arange(k)
                common = C.common_counts(sets, at, at + k)
                yield W.table({"a": b.column("a").filter(pa.array(common / (n[:k] + n[k:] - common) >= threshold))})

        return cut_lineage(both.mapInArrow(verify, "a long").distinct())

    one = cut_lineage(partners())
    gone = similar(one)
    open_ = cut_lineage(one.where("others > 0").select(F.col("a").alias("h")).distinct().join(gone.select(F.col("a").alias("h")), "h", "left_anti"))
    if not open_.isEmpty():
        rest = partners(W.BitFilter(open_)).join(open_.withColumnRenamed("h", "a"), "a", "left_semi")
        gone = gone.union(similar(rest))
    return members.join(gone.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select("s1", "s2")


def _shingle_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """(s1, s2) of the members that have an earlier similar one, by connected groups of candidates."""

    def buckets(b: pa.RecordBatch):
        data, offsets = N.flat(b.column("set"))
        number, firsts = np.frombuffer(data.tobytes(), N.U), offsets // 8
        n = np.diff(firsts)
        p = prefix_length(n, threshold)
        token, at = number[N.spread(firsts[:-1], p)], np.repeat(np.arange(b.num_rows), p)
        # Similar lines differ by one class of length at most, so they meet in the class of one of them.
        size = np.floor(np.log(n) / -np.log(threshold) + 1e-9).astype(np.int64)[at].astype(N.U)
        return np.concatenate([at, at]), np.concatenate([N.mix(token ^ N.mix(size)), N.mix(token ^ N.mix(size + N.U(1)))])

    grouped = C.groups(members, buckets, ["set"])

    def pack(batches):
        for b in N.slices(batches, "set"):
            no_id = b.column("no_id").to_numpy(zero_copy_only=False)
            numbers = [b.column(c).fill_null(0).to_numpy() for c in ("doc_id", "ka", "kb", "line")]
            both = [x + y for x, y in zip(place_bytes(no_id, *numbers), b.column("set").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("component"), b.column("weight"), pa.array(both, pa.binary())],
                                             names=["id", "component", "weight", "payload"])

    payload = grouped.join(members, "id").select("id", "component", F.lit(1).cast("long").alias("weight"), "first.*", "set").mapInArrow(
        pack, "id long, component long, weight long, payload binary"
    )
    gone = C.links(payload, lambda p, i, j: near(p, i, j, threshold), "payload", later).select(F.col("a").alias("id")).distinct()
    return members.join(gone, "id", "left_semi").select("s1", "s2")


def kept_lines(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(ka, kb, kept): the numbers of the lines with words that stay, for every document that keeps one."""
    text = W.keyed(docs)
    sent_levels = docs.sparkSession.sparkContext.broadcast(rarity_levels(text, width))

    def read(batches):
        for b in N.slices(batches, "text"):
            data, offsets = N.flat(b.column("text"))
            cuts, row = lines_of(data, offsets)
            h, firsts, full = tokens(data, cuts, width)
            number, firsts = ordered(h, firsts, sent_levels.value)
            first_line = np.searchsorted(row, np.arange(b.num_rows))
            yield b, row[full], full - first_line[row[full]], number, firsts

    def prefixes(batches):
        for _, _, _, number, firsts in read(batches):
            s1, _ = _sets(number, firsts)
            p = prefix_length(np.diff(firsts), threshold)
            token, s = number[N.spread(firsts[:-1], p)], np.repeat(s1, p)
            # Equal lines of a batch send a token once.
            order = np.lexsort((s, token))
            token, s = token[order], s[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (s[1:] != s[:-1])
            yield W.table({"h": N.signed(token[new]), "s": s[new]})

    shared = text.select("text").mapInArrow(prefixes, "h long, s long").groupBy("h").agg(
        F.min("s").alias("a"), F.max("s").alias("z"), F.count(F.lit(1)).alias("c"))
    shared = cut_lineage(shared.where("a < z").select("h", "c"))
    known = W.BitFilter(shared)

    def every(batches, with_sets):
        sent = set()
        for b, row, line, number, firsts in read(batches):
            s1, s2 = _sets(number, firsts)
            n = np.diff(firsts)
            keep = np.arange(len(n))
            if with_sets:
                p = prefix_length(n, threshold)
                hit = known(number[N.spread(firsts[:-1], p)])
                keep = np.flatnonzero(np.add.reduceat(hit.astype(np.int64), np.cumsum(p) - p) > 0) if len(p) else keep
            take = pa.array(row[keep])
            columns = {"s1": s1[keep], "s2": s2[keep], **{c: b.column(c).take(take) for c in ("doc_id", *W.KEY)}, "line": line[keep].astype(np.int32)}
            if with_sets:
                # A task sends the tokens of equal lines once.
                sets = []
                for k, name in zip(keep.tolist(), zip(s1[keep].tolist(), s2[keep].tolist())):
                    sets.append(None if name in sent else number[firsts[k] : firsts[k + 1]].tobytes())
                    sent.add(name)
                columns["set"] = pa.array(sets, pa.binary())
            yield W.table(columns)

    schema = "s1 long, s2 long, doc_id long, ka long, kb long, line int"
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "ka", "kb", "line")).alias("first")
    lines = text.mapInArrow(lambda b: every(b, True), schema + ", set binary")
    members = cut_lineage(
        lines.groupBy("s1", "s2").agg(first, F.first("set", ignorenulls=True).alias("set")).withColumn("id", F.monotonically_increasing_id())
    )

    gone = _word_pairs(members, shared, known, threshold) if width == 1 else _shingle_pairs(members, threshold)
    classes = text.mapInArrow(lambda b: every(b, False), schema).groupBy("s1", "s2").agg(first)
    stays = classes.join(gone, ["s1", "s2"], "left_anti")
    return stays.groupBy("first.ka", "first.kb").agg(F.collect_list("first.line").alias("kept"))


def report(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row per document: n_lines, n_removed and the numbers (from 0) of removed lines in ``removed``."""

    def full(batches):
        for b in N.slices(batches, "text"):
            data, offsets = N.flat(b.column("text"))
            cuts, row = lines_of(data, offsets)
            words = np.flatnonzero(np.diff(N.words(data, cuts)[2]))
            first_line = np.searchsorted(row, np.arange(b.num_rows))
            ends = np.searchsorted(row[words], np.arange(b.num_rows + 1))
            numbers = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((words - first_line[row[words]]).astype(np.int32)))
            n = np.bincount(N.owners(offsets)[data == BREAK], minlength=b.num_rows) + 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *W.KEY)), pa.array(n.astype(np.int64)), numbers],
                                             names=["doc_id", *W.KEY, "n_lines", "full"])

    own = W.keyed(docs).mapInArrow(full, "doc_id long, ka long, kb long, n_lines long, full array<int>")
    joined = own.join(kept_lines(docs, threshold, width), list(W.KEY), "left")
    removed = F.array_sort(F.array_except("full", F.coalesce("kept", F.array().cast("array<int>"))))
    return joined.select("doc_id", "n_lines", removed.alias("removed")).select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed"
    )


def clean(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The documents without removed lines; all columns stay, only ``text`` changes."""
    kept = kept_lines(docs, threshold, width)
    joined = W.with_row_key(docs).join(W.under_row_key(kept, F.col("kept").alias("__kept")), list(W.ROW_KEY), "left")
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    words = lambda s: s["x"].rlike("[^ \\t\\x0B\\f\\r]")
    stays = F.filter(numbered, lambda s: F.coalesce(F.array_contains("__kept", s["i"]), F.lit(False)) | ~words(s))
    text = F.when(F.col("text").isNotNull(), F.array_join(F.transform(stays, lambda s: s["x"]), "\n"))
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
