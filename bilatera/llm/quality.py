"""Quality classifier: interpolated modified Kneser-Ney models of byte and of word n-grams, trained on trusted text.

Counts of the longest n-grams are summed over all trusted documents; shorter ones carry continuation counts, made
from the distinct longer ones. Every probability is a join of count tables, sharded by n-gram: the n-gram's own
count, its context's totals and discounted mass, and the probability of its suffix, up from single bytes. They are
computed for all n-grams that occur in any document, so scoring needs one look-up per position. Scoring takes the
finished table shard by shard: a shard has a fixed number of rows at most, is sent to all tasks, and adds its part
to each document's log probability. More text makes more shards, never a larger one.

Bytes tell symbols and gibberish from text, but see less than a word. A second model of the same kind over three words
finds repeated or shuffled words: words are hashed to ``WORD_BITS`` bits and n-grams are packed from them. Most n-grams of
three words are in no trusted text, so they get no row: a document's log probability is that of its single words,
which are a table of at most 2 ** ``WORD_BITS`` rows in every task, plus what each word pair and each n-gram that trusted text
has adds to it by a shuffle join (``back_off_scores``). Its quantiles are those of ``WORD_KEEP`` that tell
labelled junk (quality 0) best from trusted documents that neither model has seen, each side for itself.

A document is kept when its perplexity per byte lies between two quantiles of its language, taken over trusted
documents of like length (a doubling) that the model has not seen, since short texts vary more, and its perplexity per
word does so too. Trusted documents are kept. Where fewer than ``ENOUGH`` such documents have that length, all lengths of the language count, and
else all languages. Null or empty text has no perplexity and is rejected. Null doc_id or lang is allowed;
rows that repeat are judged alike. Extra columns are ignored. Without trusted text everything that has text stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage, tidy
from . import numeric as N
from . import windows as W

ORDER = 5
#: Rows of one shard of the probability table, 16 bytes each, in every Python worker.
SHARD = 1 << 21
#: Quantiles of trusted perplexity between which documents are kept, and the slack around them as a factor.
KEEP = (0.002, 0.998)
SLACK = 1.05
ENOUGH = 100
#: The word model: its order, bits of a hashed word, and the shares of trusted text that either bound may cut off.
WORDS, WORD_BITS, WORD_KEEP = 3, 21, (0.002, 0.005, 0.01, 0.02)
#: The word model is joined in so many rounds (a power of two), by an n-gram's middle word; each round's shuffle files go before the next.
ROUNDS = 8
#: The tables of a round are made in so many steps.
STEPS = 2
#: Rows of the table that a task looks up in at once.
PLACE = 1 << 18
#: What stands before a document's first byte.
START = 0x0A


def gram_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at every byte, packed into one integer, and the row of each."""
    pad = bytes([START]) * (order - 1)
    data = np.frombuffer(pad + pad.join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    keys = np.zeros(max(0, len(data) - order + 1), np.int64)
    for k in range(order):
        keys = (keys << 8) | data[k : k + len(keys)]
    first = np.cumsum(np.concatenate([[0], lengths[:-1] + order - 1])) if len(lengths) else lengths
    return keys[N.spread(first, lengths)], np.repeat(np.arange(len(texts)), lengths)


def word_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of hashed words that ends at every word, packed into one integer, and the row of each."""
    return _word_keys(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), order)


def _word_keys(data: np.ndarray, offsets: np.ndarray, order: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, firsts = N.words(data, offsets)
    lengths = np.diff(firsts)
    # Zero stands before a document's first word.
    padded = np.zeros(len(starts) + (order - 1) * len(lengths), np.int64)
    at = N.spread(firsts[:-1] + (order - 1) * np.arange(1, len(lengths) + 1), lengths)
    padded[at] = np.maximum(N.word_values(data, starts, ends) >> N.U(64 - WORD_BITS), N.U(1)).astype(np.int64)
    keys = np.zeros(len(at), np.int64)
    for k in range(order - 1, -1, -1):
        keys = (keys << WORD_BITS) | padded[at - k]
    return keys, np.repeat(np.arange(len(lengths)), lengths)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)


def count_grams(texts: DataFrame, order: int, make=gram_keys) -> DataFrame:
    """(key, c) over all documents, ``packed`` or not; tasks sum their own counts first, in pieces of bounded size."""
    column = "packed" if "packed" in texts.columns else "text"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in N.slices(W.unpacked(batches) if column == "packed" else batches, "text", 1 << 20):
            keys, _ = make([t.encode() for t in b.column("text").to_pylist()], order)
            parts.append(np.unique(keys, return_counts=True))
            size += len(parts[-1][0])
            if size > 1 << 21:
                parts = [_merged(parts)]
                size = len(parts[0][0])
                if size > 1 << 20:
                    yield W.table({"key": parts[0][0], "c": parts[0][1]})
                    parts, size = [], 0
        if parts:
            keys, c = _merged(parts)
            yield W.table({"key": keys, "c": c})

    return texts.select(column).mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def suffix(key: Column, order: int, bits: int = 8) -> Column:
    """The n-gram of ``order`` bytes (or words of so many bits) at the end of a longer one."""
    return key.bitwiseAND(F.lit((1 << (bits * order)) - 1))


def discounts(counts: DataFrame) -> list[float]:
    """Discounts for counts of one, two, and three or more, from the numbers of n-grams seen one to four times."""
    row = counts.agg(*[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n = [float(row[f"n{i}"] or 0) for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    found = []
    for i in range(3):
        d = (i + 1) - (i + 2) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else 0.5 * (i + 1)
        found.append(min(max(d, 0.05 * (i + 1)), 0.95 * (i + 1)))
    return found


def discount(d: list[float]) -> Column:
    """What is taken off the count ``c``."""
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def probabilities(counts: DataFrame, wanted: DataFrame, order: int, bits: int = 8) -> DataFrame:
    """(key, p) for the distinct n-grams in ``wanted``."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        longer = levels[k + 1]
        levels[k] = cut_lineage(longer.groupBy(suffix(F.col("key"), k, bits).alias("key")).agg(F.count(F.lit(1)).alias("c")))
    asked = {order: wanted.select("key")}
    for k in range(order - 1, 0, -1):
        asked[k] = asked[k + 1].select(suffix(F.col("key"), k, bits).alias("key")).distinct()
    lower = None
    for k in range(1, order + 1):
        off = discount(discounts(levels[k]))
        context = F.shiftright("key", bits)
        totals = levels[k].groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(off).alias("mass"))
        # Single bytes or words have one context, the empty one.
        found = asked[k].join(levels[k], "key", "left").withColumn("context", context).join(F.broadcast(totals) if k == 1 else totals, "context", "left")
        if lower is None:
            found = found.withColumn("q", F.lit(1 / (1 << bits)))
        else:
            found = found.withColumn("tail", suffix(F.col("key"), k - 1, bits)).join(
                lower.select(F.col("key").alias("tail"), F.col("p").alias("q")), "tail"
            )
        own = F.coalesce((F.col("c") - off) / F.col("total"), F.lit(0.0))
        p = own + F.coalesce(F.col("mass") / F.col("total"), F.lit(1.0)) * F.col("q")
        # The tables of this order are read no more.
        lower = cut_lineage(found.select("key", p.alias("p")), spent=[x for x in (lower, levels[k]) if x is not None and x is not counts])
    return lower


def log_scores(docs: DataFrame, table: DataFrame, order: int, shard: int = SHARD, *, spent: Iterable[DataFrame] = ()) -> DataFrame:
    """(ka, kb, logp, n): log probability and number of bytes, summed over all shards of the table."""
    spark = docs.sparkSession
    shards = max(1, -(-table.count() // shard))
    shards += shards > 1  # rows are dealt by hash; leave room for uneven ones
    parts, tables = [], []
    for i in range(shards):
        rows = table.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == i).select("key", F.log("p").alias("v")).toArrow()
        keys, v = rows.column("key").to_numpy(), rows.column("v").to_numpy()
        sort = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[sort], v[sort].astype(np.float64)))
        tables.append(sent)
        first = i == 0

        def score(batches, sent=sent, first=first):
            keys, v = sent.value
            for b in N.slices(batches, "text"):
                got, row = gram_keys([t.encode() for t in b.column("text").to_pylist()], order)
                each, inverse = np.unique(got, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, each), max(len(keys) - 1, 0))
                worth = np.where(keys[at] == each, v[at], 0.0) if len(keys) else np.zeros(len(each))
                logp = np.bincount(row, worth[inverse], minlength=b.num_rows)
                n = np.bincount(row, minlength=b.num_rows) * first
                yield W.table({"ka": b.column("ka"), "kb": b.column("kb"), "logp": logp, "n": n.astype(np.int64)})

        parts.append(docs.select("text", *W.KEY).mapInArrow(score, "ka long, kb long, logp double, n long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = cut_lineage(out.groupBy(*W.KEY).agg(F.sum("logp").alias("logp"), F.sum("n").alias("n")), spent=spent)
    for sent in tables:
        sent.destroy()
    return out


def word_scores(docs: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """(ka, kb, word_logp, words): log probability and number of words, by a join on n-grams counted per document.

    ``table`` has all their n-grams; ``back_off_scores`` does without.
    """

    def emit(batches):
        for b in N.slices(batches, "text"):
            keys, row = word_keys([t.encode() for t in b.column("text").to_pylist()], order)
            sort = np.lexsort((keys, row))
            keys, row = keys[sort], row[sort]
            new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]))) if len(keys) else keys
            take = pa.array(row[new])
            yield W.table({"key": keys[new], "c": np.diff(np.append(new, len(keys))), **{k: b.column(k).take(take) for k in W.KEY}})

    grams = docs.select("text", *W.KEY).mapInArrow(emit, "key long, c long, ka long, kb long")
    found = grams.join(table.select("key", F.log("p").alias("v")), "key")
    return found.groupBy(*W.KEY).agg(F.sum(F.col("c") * F.col("v")).alias("word_logp"), F.sum("c").alias("words"))

LAST, PAIR = (1 << WORD_BITS) - 1, (1 << 2 * WORD_BITS) - 1


def _pairs(counts: DataFrame, taken: Column, some: Column) -> DataFrame:
    """(key, n, total, mass) of word pairs: how many words stand before them, and as contexts their total count and discounted mass."""
    none, zero = F.lit(0).cast("long"), F.lit(0.0)
    ends = counts.select(suffix(F.col("key"), 2, WORD_BITS).alias("key"), F.lit(1).cast("long").alias("n"), none.alias("total"), zero.alias("mass"))
    contexts = counts.select(F.shiftright("key", WORD_BITS).alias("key"), none.alias("n"), F.col("c").alias("total"), taken.alias("mass"))
    return ends.unionByName(contexts).where(some).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "total", "mass")])


class _Words:
    """Probabilities of single words and what they leave as contexts of pairs, in arrays by hashed word."""

    def __init__(self, pairs: DataFrame):
        seen = pairs.where("n > 0").withColumnRenamed("n", "c")
        self.discounts = discounts(seen)
        ends = cut_lineage(seen.groupBy(suffix(F.col("key"), 1, WORD_BITS).alias("key")).agg(F.count(F.lit(1)).alias("c")))
        d = discounts(ends)
        off = discount(self.discounts)
        starts = seen.groupBy(F.shiftright("key", WORD_BITS).alias("key")).agg(F.sum("c").alias("total"), F.sum(off).alias("mass"))
        # A row for each hashed word at most.
        ends, starts = ends.select("key", "c", discount(d).alias("off")).toArrow(), starts.toArrow()
        c, off = ends.column("c").to_numpy(), ends.column("off").to_numpy()
        p = np.full(LAST + 1, (off.sum() / c.sum() if len(c) else 1.0) / (LAST + 1))
        p[ends.column("key").to_numpy()] += (c - off) / max(c.sum(), 1)
        total, left = np.ones(LAST + 1), np.ones(LAST + 1)
        at = starts.column("key").to_numpy()
        total[at] = starts.column("total").to_numpy()
        left[at] = starts.column("mass").to_numpy() / total[at]
        # Every task has a copy on its disk; most words are rare and share their values.
        self.sent = pairs.sparkSession.sparkContext.broadcast([zstandard.compress(x.tobytes(), 1) for x in (p, total, left)])
        self.arrays = None

    def __getstate__(self):
        return {**self.__dict__, "arrays": None}

    def _read(self) -> list[np.ndarray]:
        if self.arrays is None:
            self.arrays = [np.frombuffer(zstandard.decompress(x)) for x in self.sent.value]
        return self.arrays

    def alone(self, key: np.ndarray) -> np.ndarray:
        """The probability of a pair's last word where the pair is not known."""
        p, _, left = self._read()
        return left[(key >> WORD_BITS) & LAST] * p[key & LAST]

    def pair(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The probability of a known pair's last word after the first, from the number of words before it."""
        off = np.array([0.0, *self.discounts])[np.minimum(n, 3)]
        return (n - off) / self._read()[1][(key >> WORD_BITS) & LAST] + self.alone(key)


def _press(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def _dealt(key: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys by place and value, the places in use, and where each one's keys begin and end."""
    place = (N.mix(key.view(N.U)) % N.U(places)).astype(np.int64)
    sort = np.lexsort((key, place))
    used, first = np.unique(place[sort], return_index=True)
    return sort, used, np.append(first, len(key))


def in_turns(counts: DataFrame, key: Column, rounds: int = ROUNDS) -> DataFrame:
    """The rows in order of their round and step, so that each reads its own part."""
    return counts.withColumn("turn", key.bitwiseAND(F.lit(rounds * STEPS - 1))).sortWithinPartitions("turn", "key")


def back_off_scores(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(ka, kb, word_logp, words): log probability and number of words by the counted n-grams of three words of trusted text.

    The sum over a document's words of the logarithm of the probability after one word if the pair were unknown (``_Words.alone``), and
    for known pairs and n-grams of what they change: a pair's own probability against that, the mass that it leaves as a context, and
    an n-gram's own probability against both. Only those are looked up; the sum is that of ``probabilities`` for every n-gram.

    A look-up is a shuffle by places, parts of the hashed keys: a place gets its part of the table first and then, packed by batch,
    the keys of the documents, so a task holds one part and one batch at a time.
    """
    turn = lambda key: key.bitwiseAND(F.lit(rounds * STEPS - 1))
    first, text = F.shiftright("key", WORD_BITS), docs.select("text", *W.KEY)
    own = discounts(counts)
    halves = [_pairs(counts, discount(own), turn(F.col("key")) % STEPS == i) for i in range(STEPS)]
    halves = [cut_lineage(in_turns(x, F.col("key"), rounds), compression="zstd") for x in halves]
    pairs = reduce(DataFrame.unionByName, halves)
    words = _Words(pairs)
    # No more places than that: each sends back a row for every document.
    places = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(counts.count() + pairs.count()) // (rounds * PLACE)))

    def read(batches):
        for b in N.slices(batches, "text", 1 << 21):
            yield b, *_word_keys(*N.flat(b.column("text")))

    def alone(batches):
        for b, keys, row in read(batches):
            logp = np.bincount(row, np.log(words.alone(keys & PAIR)), minlength=b.num_rows)
            n = np.bincount(row, minlength=b.num_rows).astype(np.int64)
            yield W.table({**{k: b.column(k) for k in W.KEY}, "logp": logp, "n": n}).filter(pa.array(n > 0))

    def gains(key, c, total, mass, n):
        """What a use of each n-gram or (complemented) pair adds, and what a pair adds as a context."""
        pair = np.where(key < 0, ~key, key & PAIR)
        back = mass / np.maximum(total, 1)
        lower = np.where(n > 0, words.pair(pair, n), 1.0)
        off = np.array([0.0, *own])[np.minimum(c, 3)]
        long = np.log1p((c - off) / np.maximum(total, 1) / np.where(key < 0, 1.0, back * lower))
        short = np.where(n > 0, np.log(lower / words.alone(pair)), 0.0)
        return np.where(key < 0, short, long), np.where((key < 0) & (total > 0), np.log(np.where(total > 0, back, 1.0)), 0.0)

    def mixed(batches):
        for b in batches:
            yield W.table({"h": N.signed(N.mix(b.column("key").to_numpy().view(N.U)))})

    def parts(batches):
        for b in batches:
            columns = [b.column(k).to_numpy() for k in fields]
            sort, used, cuts = _dealt(columns[0], places)
            loads = [(hi - lo, _press(*(x[sort[lo:hi]] for x in columns))) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            n, load = ([x[i] for x in loads] for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([0] * len(n), pa.int32()), pa.array(n, pa.int64()),
                                              pa.array(load, pa.binary()), pa.array([b""] * len(n), pa.binary())], names=list(names))

    def grams(r, known):
        def emit(batches):
            for b, keys, row in read(batches):
                last = np.append(row[1:] != row[:-1], True) if len(row) else row.astype(bool)
                ours = (keys >> WORD_BITS) & (rounds - 1) == r
                also = keys & (rounds - 1) == r
                begins = row[np.append(True, last[:-1])] if len(row) and r == 0 else row[:0]
                # A pair is the context of the next word, if there is one; what stands before a document is that of its first word.
                key = np.concatenate([keys[ours], ~(keys[also] & PAIR), np.full(len(begins), ~0)])
                at = np.concatenate([row[ours], row[also], begins])
                n, m, k = int(ours.sum()), int(also.sum()), len(begins)
                uses = np.concatenate([np.ones(n + m, np.int32), np.zeros(k, np.int32)])
                contexts = np.concatenate([np.zeros(n, np.int32), (~last[also]).astype(np.int32), np.ones(k, np.int32)])
                hit = known(N.mix(key.view(N.U)))
                key, at, uses, contexts = key[hit], at[hit].astype(np.int32), uses[hit], contexts[hit]
                found = []
                sort, used, cuts = _dealt(key, places)
                for place, lo, hi in zip(used.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                    s = sort[lo:hi]
                    rows, index = np.unique(at[s], return_inverse=True)
                    ids = [b.column(c).to_numpy()[rows] for c in W.KEY]
                    # Keys are in order, so their differences have fewer bits.
                    found.append((place, len(s), _press(np.diff(key[s], prepend=0), index.astype(np.int32), uses[s], contexts[s]), _press(*ids)))
                place, n, load, who = ([f[i] for f in found] for i in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array([1] * len(found), pa.int32()), pa.array(n, pa.int64()),
                                                  pa.array(load, pa.binary()), pa.array(who, pa.binary())], names=list(names))

        return emit

    def look_up(batches):
        now, held, table = None, [], None
        for b in batches:
            for place, side, n, load, who in zip(*(b.column(c).to_pylist() for c in names)):
                if place != now:
                    now, held, table = place, [], None
                raw = zstandard.decompress(load)
                if side == 0:
                    held.append([np.frombuffer(raw, np.float64 if f == "mass" else np.int64, n, 8 * n * i) for i, f in enumerate(fields)])
                    continue
                if table is None:
                    columns = [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(0, np.int64)] * len(fields)
                    sort = np.argsort(columns[0])
                    held, columns = [], [x[sort] for x in columns]
                    table = [columns[0], *gains(*columns)]
                if not len(table[0]):
                    continue
                key = np.cumsum(np.frombuffer(raw, np.int64, n))
                index, uses, contexts = (np.frombuffer(raw, np.int32, n, 8 * n + 4 * n * i) for i in range(3))
                at = np.minimum(np.searchsorted(table[0], key), len(table[0]) - 1)
                ids = np.frombuffer(zstandard.decompress(who), np.int64).reshape(2, -1)
                worth = np.where(table[0][at] == key, uses * table[1][at] + contexts * table[2][at], 0.0)
                yield W.table({"ka": ids[0], "kb": ids[1], "logp": np.bincount(index, worth, minlength=ids.shape[1])})

    fields = ("key", "c", "total", "mass", "n")
    names = ("place", "side", "n", "load", "who")
    packed = "place long, side int, n long, load binary, who binary"

    def long_ones(t: int) -> DataFrame:
        tail = pairs.where((turn(first) == t) & (F.col("n") > 0)).select(F.col("key").alias("tail"), "n")
        some = counts.where(F.col("turn") == t if "turn" in counts.columns else turn(first) == t)
        some = some.select("key", "c", first.alias("context"), suffix(F.col("key"), 2, WORD_BITS).alias("tail"))
        contexts = pairs.where(F.col("turn") == t).select(F.col("key").alias("context"), "total", "mass")
        return cut_lineage(some.join(contexts, "context").join(tail, "tail").select(*fields), compression="zstd")

    def score(r: int) -> DataFrame:
        turns = [r + rounds * i for i in range(STEPS)]
        made = [long_ones(t) for t in turns]
        short = pairs.where(F.col("turn").isin(turns)).select(F.bitwise_not("key").alias("key"), F.lit(0).cast("long").alias("c"), "total", "mass", "n")
        table = reduce(DataFrame.unionByName, [*made, short])
        known = W.BitFilter(table.select("key").mapInArrow(mixed, "h long"))
        tidy(docs.sparkSession)
        dealt = table.mapInArrow(parts, packed).unionByName(text.mapInArrow(grams(r, known), packed))
        found = dealt.repartition("place").sortWithinPartitions("place", "side").mapInArrow(look_up, "ka long, kb long, logp double")
        found = found.groupBy(*W.KEY).agg(F.sum("logp").alias("logp")).withColumn("n", F.lit(0).cast("long"))
        found = cut_lineage(found, spent=made)
        known.sent.destroy()
        return found

    sums = [cut_lineage(text.mapInArrow(alone, "ka long, kb long, logp double, n long")), *[score(r) for r in range(rounds)]]
    out = reduce(DataFrame.unionByName, sums).groupBy(*W.KEY)
    out = cut_lineage(out.agg(F.sum("logp").alias("word_logp"), F.sum("n").alias("words")), spent=[*halves, *sums])
    words.sent.destroy()
    return out


def _with_cuts(scores: DataFrame, held: DataFrame, column: str, quantiles: list[float], name: str) -> DataFrame:
    """Quantiles of ``column`` over held-out trusted documents, by language and size as far as there are enough."""
    cut = F.percentile_approx(column, quantiles, 10_000)
    enough = F.count(column) >= ENOUGH
    # A few rows for each language, and one for all.
    by_size = held.where("lang is not null").groupBy("lang", "size").agg(F.when(enough, cut).alias("like"))
    by_lang = held.where("lang is not null").groupBy("lang").agg(F.when(enough, cut).alias("own"))
    overall = held.agg(cut.alias("all"))
    joined = scores.join(by_size, ["lang", "size"], "left").join(by_lang, "lang", "left").join(F.broadcast(overall))
    return joined.withColumn(name, F.coalesce("like", "own", "all")).drop("like", "own", "all")


def _inside(column: str, low: Column, high: Column) -> Column:
    return F.col(column).between(F.coalesce(low / SLACK, F.lit(0.0)), F.coalesce(high * SLACK, F.lit(float("inf"))))


def _best_cuts(scores: DataFrame, held: Column, choices: int) -> tuple[int, int]:
    """Which lower and which upper cut tells labelled junk best from held-out trusted text."""
    value, sides = F.col("word_perplexity"), []
    for i in range(choices):
        sides += [value < F.col("word_cuts")[i] / SLACK, value > F.col("word_cuts")[choices + i] * SLACK]
    share = lambda of, out: F.coalesce(F.avg(F.when(of, out.cast("double"))), F.lit(0.0))
    row = scores.where(value.isNotNull()).agg(
        *[(share(F.col("junk"), x) - share(held, x)).alias(f"gain{i}") for i, x in enumerate(sides)]).first()
    gain = np.array([row[f"gain{i}"] for i in range(2 * choices)], float).reshape(choices, 2)
    return int(gain[:, 0].argmax()), int(gain[:, 1].argmax())


def judge(docs: DataFrame, labels: DataFrame, *, order: int = ORDER, keep: tuple[float, float] = KEEP, shard: int = SHARD) -> DataFrame:
    """One row per document: perplexities per byte and word, the bounds of its language, ``trusted`` and ``kept``."""
    text = W.keyed(docs, "lang")
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").where("doc_id is not null").distinct()
    bad = labels.where("quality = 0 and doc_id is not null").select("doc_id").distinct()
    seen = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(4)) != 0  # a quarter sets the quantiles only
    known = W.BitFilter(good.select(F.xxhash64("doc_id").alias("h")))

    def labelled(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(known(b.column("h").to_numpy().view(N.U))))

    # Of the text only what is probably trusted is shuffled, and compressed.
    some = text.where(seen & F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    trusted = W.packed(some, labelled).drop("h").join(good.hint("merge"), "doc_id", "left_semi")
    counts = cut_lineage(count_grams(trusted, order))
    wanted = cut_lineage(count_grams(text, order).select("key"))
    table = probabilities(counts, wanted, order)
    ids = text.select("doc_id", "lang", *W.KEY)
    scores = ids.join(log_scores(text, table, order, shard, spent=[counts, wanted, table]), list(W.KEY)).withColumn(
        "perplexity", F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n")))
    )
    words = cut_lineage(in_turns(count_grams(trusted, WORDS, word_keys), F.shiftright("key", WORD_BITS)), compression="zstd")
    by_word = back_off_scores(text, words)
    scores = scores.join(by_word, list(W.KEY), "left").withColumn("word_perplexity", F.exp(-F.col("word_logp") / F.col("words")))
    scores = scores.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left")
    scores = cut_lineage(scores.join(bad.withColumn("junk", F.lit(True)), "doc_id", "left"), spent=[words])
    scores = scores.withColumn("size", F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int")).fillna(False, ["trusted", "junk"])
    unseen = F.col("trusted") & ~seen
    held = scores.where(unseen & F.col("perplexity").isNotNull())
    lows = list(WORD_KEEP)
    bounds = _with_cuts(scores, held, "perplexity", list(keep), "cuts")
    bounds = cut_lineage(_with_cuts(bounds, held, "word_perplexity", [*lows, *[1 - q for q in lows]], "word_cuts"))
    i, j = _best_cuts(bounds, unseen, len(lows))
    low, high = (F.col("cuts")[k] for k in (0, 1))
    word_low, word_high = F.col("word_cuts")[i], F.col("word_cuts")[len(lows) + j]
    # White space alone has bytes and no words.
    inside = _inside("perplexity", low, high) & F.coalesce(_inside("word_perplexity", word_low, word_high), F.lit(True))
    return bounds.select(
        "doc_id", *W.KEY, "perplexity", (low / SLACK).alias("low"), (high * SLACK).alias("high"),
        "word_perplexity", (word_low / SLACK).alias("word_low"), (word_high * SLACK).alias("word_high"),
        "trusted", (F.col("perplexity").isNotNull() & (F.col("trusted") | inside)).alias("kept"),
    )
