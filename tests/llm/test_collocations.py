"""Collocations against phrases counted one by one, with budgets so small that pairs, triples and suffixes are cut."""

import random
import re
from collections import Counter

import pytest

from bilatera.llm import collocations as C

from .fixtures import SCHEMA, corpus


def brute(rows, least, top):
    f, n, langs = Counter(), Counter(), {}
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(4, len(words) - i) + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    drop = set()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= C.COVERED * f[lang, w[i : i + k]]:
                    drop.add((lang, w[i : i + k]))
    found = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in drop:
            cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, all_ in found.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(all_)[:top], 1))


def prose(seed=2, docs=300):
    r = random.Random(seed)
    words = ["The", "of", "and", "é", "ß", "x" * 60, "a-b", "New", "york", "city", "hall", "in", "to"]
    weights = [30, 20, 10, 3, 2, 1, 2, 4, 4, 4, 4, 8, 8]
    out = []
    for i in range(docs):
        text = []
        for _ in range(r.randint(0, 12)):
            text += ["New York City Hall"] if r.random() < 0.3 else r.choices(words, weights, k=r.randint(1, 9))
            text.append(r.choice([".", ",", "\n", "", "", ";", "\t", "  "]))
        out.append((i, " ".join(text), r.choice(["en", "en", "en", "de", None, "und", ""]), "s", 1, 1, "k", 0, "x", 9))
    return out


def check(spark, rows, least, top=C.TOP, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = C.mine(df, least=least, top=top, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, top)


@pytest.mark.parametrize("budget", [1 << 18, 60, 7])
def test_against_counting(spark, budget):
    check(spark, prose(), 5, budget=budget)


def test_corpus_with_edges(spark):
    check(spark, corpus(), 3, budget=500)


def test_few_of_a_language_and_ties(spark):
    check(spark, prose(7, 120), 2, top=9)


def test_hot_passage(spark):
    """One passage in thousands of rows, equal in id and text too: its pairs, triples and suffixes all exceed the budget."""
    rows = [(1 if i % 2 else i, "a hot passage of six words, and more text here", "en", "s", 1, 1, "k", 0, "x", 9) for i in range(4000)]
    check(spark, rows + prose(3, 60), 5, budget=100)


def test_nothing_to_find(spark):
    check(spark, [(1, None, "en", "s", 1, 1, "k", 0, "x", 9), (2, " . ", None, "s", 1, 1, "k", 0, "x", 9)], 2)
    assert C.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, "all words differ here", "en", "s", 1, 1, "k", 0, "x", 9)] * 3, 3)
