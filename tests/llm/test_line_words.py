"""Lines as sets of words: exact against brute force, and one changed word is found at every length from ten."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline as pipeline
from bilatera.llm import line_dedup
from tests.llm.fixtures import SCHEMA, corpus, frame


def rows_of_text():
    r = random.Random(8)
    out = [x for x in corpus() if x[0] is not None and x[0] != 407]
    common = [f"c{k}" for k in range(12)]
    for i in range(150):  # near copies of a few bases, around the threshold, of common and of rare words
        base = [f"{r.choice('abc')}{k}" for k in range(r.choice([4, 5, 8, 9, 10, 20, 30]))]
        for _ in range(r.randint(0, 4)):
            base[r.randrange(len(base))] = r.choice([*common, f"x{r.randint(0, 9)}"])
        out.append((1000 + i, " ".join(base) + "\n" + " ".join(r.sample(common, r.randint(4, 12))), "en", "s", 1, 1, "k", 0, "x", 9))
    return out


def brute(rows):
    lines = []
    for n, x in enumerate(rows):
        for k, line in enumerate((x[1] or "").split("\n")):
            words = frozenset(line.encode().split())
            if words:
                lines.append(((x[0], k), n, words))
    gone = defaultdict(list)
    for place, n, words in lines:
        if any(q < place and len(words & w) >= 0.8 * len(words | w) for q, _, w in lines):
            gone[n].append(place[1])
    return gone


@pytest.mark.parametrize("block", [1024, 3])
def test_words_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)  # 3: tokens are split over blocks
    rows = rows_of_text()
    want = brute(rows)
    got = {x.doc_id: x.removed for x in line_dedup.report(frame(spark, rows), width=1).collect()}
    assert got == {x[0]: want[n] for n, x in enumerate(rows)}


def test_one_changed_word_in_the_pipeline(spark, tmp_path):
    rows = []
    for k, n in enumerate((10, 20, 48)):
        words = [f"w{k}x{j}" for j in range(n)]
        rows.append((2 * k, " ".join(words), "en", "s", 1, 1, "k", 0, "x", 9))
        words[n // 2] = "other"
        rows.append((2 * k + 1, " ".join(words), "en", "s", 1, 1, "k", 0, "x", 9))
    out = {x.doc_id: x.text for x in pipeline.dedup_lines(spark, frame(spark, rows), str(tmp_path)).collect()}
    assert [bool(out[i]) for i in range(6)] == [True, False] * 3
