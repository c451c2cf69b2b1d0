"""The word model: Kneser-Ney on words, and repeated words in ordinary prose are rejected."""

import random
from collections import Counter

import pytest

from bilatera.llm import quality
from tests.llm.fixtures import SCHEMA
from tests.llm.test_models import LABELS


def test_word_counts_and_probabilities(spark):
    texts = ["", "one two two", "  one\ttwo\n", "three one two two"]
    got = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = {r.key: r.c for r in quality.count_grams(got, 3, quality.word_keys).collect()}
    names = {w: int(quality.word_keys([w.encode()], 1)[0][0]) for w in ("one", "two", "three")}
    want = Counter()
    for t in texts:
        w = [0, 0, *(names[x] for x in t.split())]
        want.update((w[k] << 42) | (w[k + 1] << 21) | w[k + 2] for k in range(len(w) - 2))
    assert counts == want
    table = spark.createDataFrame([(k, 0.5) for k in counts], "key long, p double")
    from bilatera.llm import windows as W

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scored = [r.words for r in quality.word_scores(W.keyed(docs), table, 3).collect()]
    assert sorted(scored) == [2, 3, 4]
    # A context's probabilities add up to one over all words.
    c = spark.createDataFrame(list(counts.items()), "key long, c long")
    context = ((names["one"] << 21) | names["two"]) << 21
    grams = spark.range(context, context + (1 << 21)).toDF("key")
    total = quality.probabilities(c, grams, 3, quality.WORD_BITS).groupBy().sum("p").first()[0]
    assert total == pytest.approx(1, rel=1e-9)


def test_repeated_words_in_prose_go(spark):
    r = random.Random(6)
    # Five bytes never reach from one word's own letters to the next one's.
    words = ["qu" + "".join(r.choice("abcdefghij") for _ in range(6)) + "n" for _ in range(120)]
    after = {w: r.sample(words, 3) for w in words}

    def prose(n):
        out = [r.choice(words)]
        while len(out) < n:
            out.append(r.choice(after[out[-1]]))
        return out

    def run():
        w = r.choice(words)
        return prose(70) + [w] * 30 + prose(20)

    rows = [(i, " ".join(run() if i % 10 == 0 else prose(120)), "en", "s", 1, 1, "k", 0, "x", 9) for i in range(1000)]
    marks = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(800)], LABELS)
    judged = quality.judge(spark.createDataFrame(rows, SCHEMA), marks).collect()
    by_bytes = [x.low <= x.perplexity <= x.high for x in judged if x.doc_id % 10 == 0 and x.doc_id >= 800]
    assert sum(by_bytes) >= 15  # of 20: the model of bytes alone keeps them
    got = {x.doc_id: x.kept for x in judged}
    assert sum(got[i] for i in range(800, 1000) if i % 10 == 0) <= 2
    assert sum(got[i] for i in range(800, 1000) if i % 10) >= 0.93 * 180


def test_back_off_scores_equal_the_model_of_all_ngrams(spark, monkeypatch):
    from bilatera.llm import windows as W

    r = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    texts = ["", " ", "w1", "w1 w1", *[" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(60)]]
    texts += [" ".join(f"new{i}x{k}" for k in range(90)) + " w3 w4 w5" for i in range(40)]
    texts += [texts[9], "w7 w8 " * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    text, trusted = W.keyed(docs), docs.where("doc_id < 44 and doc_id % 3 > 0")
    counts = quality.cut_lineage(quality.count_grams(trusted, 3, quality.word_keys))
    every = quality.count_grams(text, 3, quality.word_keys).select("key")
    table = quality.probabilities(counts, every, 3, quality.WORD_BITS)
    want = {(x.ka, x.kb): (pytest.approx(x.word_logp, rel=1e-11), x.words) for x in quality.word_scores(text, table, 3).collect()}
    assert len(want) == len(texts) - 2
    written = []

    def cut(df, **more):
        out = storage_cut(df, **more)
        written.append(out.count())
        return out

    storage_cut = quality.cut_lineage
    monkeypatch.setattr(quality, "cut_lineage", cut)
    for rounds in (1, 4):
        got = quality.back_off_scores(text, counts, rounds).collect()
        assert {(x.ka, x.kb): (x.word_logp, x.words) for x in got} == want
    # Nothing is written for n-grams that are in no trusted text.
    assert max(written) <= max(counts.count(), 2 * len(texts)) < every.count() / 2
    none = quality.back_off_scores(text, counts.limit(0), 2).collect()
    assert all(x.word_logp == pytest.approx(-x.words * quality.WORD_BITS * 0.6931471805599453) for x in none)
