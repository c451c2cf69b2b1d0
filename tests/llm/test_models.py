"""Quality, language and mixing: held-out accuracy, and exact counts and rates on small cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from bilatera.llm import language, mixing, quality
from tests.llm.fixtures import SCHEMA, frame

LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(40)] + [(None, 1, 0), (3, 1, 0), (999, 1, None), (5, None, None)], LABELS)


def test_gram_counts(spark):
    texts = ["", "aab", "ab"]
    got = {r.key: r.c for r in quality.count_grams(spark.createDataFrame([(t,) for t in texts], "text string"), 3).collect()}
    want = Counter()
    for t in texts:
        raw = b"\n\n" + t.encode()
        want.update(int.from_bytes(raw[k : k + 3], "big") for k in range(len(t)))
    assert got == want


def brute_probability(counts, order):
    """Interpolated modified Kneser-Ney, straight from the definition."""
    levels = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def off(k, c):
        n = [sum(v == i for v in levels[k].values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        i = min(c, 3) - 1
        d = (i + 1) - (i + 2) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else 0.5 * (i + 1)
        return min(max(d, 0.05 * (i + 1)), 0.95 * (i + 1))

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        mates = {h: c for h, c in levels[k].items() if h[:-1] == g[:-1]}
        total = sum(mates.values())
        if not total:
            return p(g[1:])
        c = levels[k].get(g, 0)
        return (c - off(k, c) if c else 0) / total + sum(off(k, c) for c in mates.values()) / total * p(g[1:])

    return p


def test_probabilities_are_modified_kneser_ney(spark):
    r = random.Random(3)
    text = "".join(r.choice("aaabbc d") for _ in range(400))
    raw = b"\n\n" + text.encode()
    counts = Counter(raw[k : k + 3] for k in range(len(text)))
    asked = [*counts, b"zzz", b"aaz", b"abz"]
    number = lambda g: int.from_bytes(g, "big")
    got = quality.probabilities(
        spark.createDataFrame([(number(g), c) for g, c in counts.items()], "key long, c long"),
        spark.createDataFrame([(number(g),) for g in asked], "key long"), 3,
    ).collect()
    p = brute_probability(counts, 3)
    assert {r.key: pytest.approx(r.p, rel=1e-9) for r in got} == {number(g): p(g) for g in asked}
    # A context's probabilities add up to one over all bytes.
    assert math.isclose(sum(p(b"aa" + bytes([b])) for b in range(256)), 1, rel_tol=1e-9)


def test_shards_add_up_and_all_rows_are_judged(spark):
    docs = frame(spark)
    rows = lambda shard: sorted((repr(r.doc_id), r.ka, r.kb, r.kept, r.trusted, None if r.perplexity is None else round(r.perplexity, 9))
                                for r in quality.judge(docs, labels(spark), shard=shard).collect())
    one = rows(1 << 21)
    assert one == rows(150)
    assert len(one) == docs.count()
    assert all(not r[3] for r in one if r[5] is None) and sum(r[4] for r in one) > 10


def test_quality_without_trusted_text_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    got = quality.judge(frame(spark), none).collect()
    assert all(r.kept == (r.perplexity is not None) for r in got) and not any(r.trusted for r in got)
    assert quality.judge(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_quality_keeps_clean_and_drops_junk(spark):
    r = random.Random(1)
    clean = lambda: " ".join(r.choice(["the", "house", "stands", "near", "a", "quiet", "river"]) for _ in range(60))
    junk = lambda: "".join(chr(r.randint(33, 126)) for _ in range(300))
    rows = [(i, clean() if i % 10 else junk(), "en", "s", 1, 1, "k", 0, "x", 9) for i in range(600)]
    marks = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(500)], LABELS)
    got = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(rows, SCHEMA), marks).collect()}
    assert sum(got[i] for i in range(500, 600) if i % 10) >= 88 and not any(got[i] for i in range(500, 600) if i % 10 == 0)


def test_language(spark):
    words = {"en": "the and of house water".split(), "de": "der und das Häuser über".split(), "fr": "le où été garçon des".split()}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(30)), lang) for i in range(240) for lang in [("en", "de", "fr")[i % 3]]]
    rows += [(500, None, "en"), (501, "123 !!", "de"), (None, "the house of water", None), (502, "", "fr"), (503, "the the", None), (503, "the the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang")
    got = language.predict(docs, language.fit(docs)).collect()
    assert len(got) == len(rows)
    right = [x.lang_pred == ("en", "de", "fr")[x.doc_id % 3] for x in got if x.doc_id is not None and x.doc_id < 240 and x.held_out]
    assert len(right) > 30 and all(right)
    und = {x.doc_id for x in got if x.lang_pred == "und"}
    assert und == {500, 501, 502} and all(x.score == 0 for x in got if x.lang_pred == "und")
    assert all(0 <= x.score <= 1 for x in got) and [x.held_out for x in got if x.doc_id is None] == [False]
    nothing = language.predict(docs, language.fit(docs.where("lang is null"))).collect()
    assert {(x.lang_pred, x.score) for x in nothing} == {("und", 0.0)}
    assert language.predict(docs.limit(0), None).count() == 0


def test_mixing_meets_targets_and_learns_domains(spark):
    r = random.Random(4)
    word = lambda d: r.choice({"clean": ["sun", "sea"], "toxic": ["awful"], "junk": ["!!!"]}[d] if r.random() < 0.3 else [f"w{r.randint(0, 60)}"])
    kinds = [("clean", "clean", "toxic", "junk")[i % 4] for i in range(800)]
    rows = [(i, " ".join(word(d) for _ in range(40)), "en", "s", 1, 1, "k", 0, "x", 9) for i, d in enumerate(kinds)]
    rows += [(None, None, None, None, None, 1, "k", 0, "x", 9), (900, "", None, None, None, 1, "k", 0, "x", 9)]
    marks = [(i, int(d != "junk"), int(d == "toxic")) for i, d in enumerate(kinds) if i < 500]
    rated, info = mixing.mix(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, LABELS), {"clean": 0.8, "toxic": 0.1, "junk": 0.1})
    assert np.allclose(info["reached"], info["want"], atol=2e-3 * info["want"].sum())
    got = rated.collect()
    assert len(got) == len(rows) and all(x.rate >= 0 and x.copies >= 0 for x in got)
    right = [info["domains"][int(np.argmax(x.p))] == kinds[x.doc_id] for x in got if x.doc_id is not None and 500 <= x.doc_id < 800]
    assert np.mean(right) > 0.97
    # Rates are the optimum: no single small change of a rate lowers the loss.
    p, tokens, rate = np.array([x.p for x in got]), np.array([x.tokens for x in got]), np.array([x.rate for x in got])
    slope = p @ ((rate * tokens @ p - info["want"]) / info["have"]) + mixing.PULL * (rate - 1)
    assert np.abs(slope[(rate > 0) & (tokens > 0)]).max() < 0.02 and slope[rate == 0].min(initial=0) > -0.02


def test_mixing_edges(spark):
    docs, none = frame(spark), spark.createDataFrame([], LABELS)
    rated, info = mixing.mix(docs, none, {"unlabelled": 1.0})
    assert info["domains"] == ["unlabelled"] and rated.count() == docs.count()
    empty, _ = mixing.mix(docs.limit(0), labels(spark), {"clean": 1.0})
    assert empty.count() == 0
