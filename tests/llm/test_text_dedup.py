"""Substring dedup, Jaccard join and line dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest

from bilatera.llm import candidates, jaccard, line_dedup, substring_rlz, substring_suffix, windows
from tests.llm.fixtures import SCHEMA, corpus, frame

TEXTS = [(r[0], r[1] or "") for r in corpus()]


def key(*values):
    return tuple(repr(v) for v in values)


def multiset(rows):
    return Counter(key(*r) for r in rows)


def brute_suffix(width):
    seen = Counter()
    for _, t in TEXTS:
        raw = t.encode()
        seen.update(raw[p : p + width] for p in range(len(raw) - width + 1))
    for i, t in TEXTS:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if seen[raw[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        yield i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("width,in_task", [(200, 2000), (40, 2000), (40, 2)])
def test_suffix(spark, monkeypatch, width, in_task):
    monkeypatch.setattr(windows, "IN_TASK", in_task)  # 2: nearly all marks take the shuffled way
    got = substring_suffix.remove_repeats(frame(spark), width).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert multiset(got.collect()) == multiset(brute_suffix(width))


def test_suffix_spans_give_the_text_back(spark):
    for r in substring_suffix.remove_repeats(frame(spark), 40).where("doc_id is not null and doc_id <> 407").collect():
        raw, kept, at = dict(TEXTS)[r.doc_id].encode(), b"", 0
        for s in r.spans:
            kept, at = kept + raw[at : s.start], s.end
        assert kept + raw[at:] == r.kept


@pytest.mark.parametrize("in_task", [2000, 1])
def test_rlz(spark, monkeypatch, in_task):
    monkeypatch.setattr(windows, "IN_TASK", in_task)
    first = {}
    for i, t in TEXTS:
        w = t.encode().split()
        for p in range(len(w) - 12):
            if i is not None:
                first[tuple(w[p : p + 13])] = min(first.get(tuple(w[p : p + 13]), i), i)
    want = []
    for i, t in TEXTS:
        w = t.encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if i is not None and first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = substring_rlz.remove_known(frame(spark))
    assert multiset(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == multiset(want)
    words = {i: t.encode().split() for i, t in TEXTS if i != 407}
    for r in got.where("doc_id is not null and doc_id <> 407").collect():
        for f in r.factors:
            if f.ref_doc != 407:
                assert f.length >= 13 and f.ref_doc < r.doc_id
                assert words[r.doc_id][f.start : f.start + f.length] == words[f.ref_doc][f.ref_start : f.ref_start + f.length]


def brute_jaccard(threshold=0.8):
    sets = []
    for _, t in TEXTS:
        w = t.encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)]))
    near = [[j for j in range(len(sets)) if j != i and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(sets))]
    component = [None] * len(sets)
    for i in range(len(sets)):
        if component[i] is None:
            todo, found = [i], {i}
            while todo:
                new = set(near[todo.pop()]) - found
                found |= new
                todo += new
            least = min((TEXTS[k][0] for k in found if TEXTS[k][0] is not None), default=None)
            for k in found:
                component[k] = least
    return [(TEXTS[i][0], component[i], len(near[i])) for i in range(len(sets))]


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(candidates.links, "__defaults__", (candidates.counts_and_forest, block))  # 3: the near copies are split over blocks
    got = jaccard.join(frame(spark)).collect()
    assert multiset((r.doc_id, r.component_id, r.n_links) for r in got) == multiset(brute_jaccard())
    groups = defaultdict(int)
    for r in got:
        if r.component_id not in (None, 407):  # ids of several texts
            groups[r.component_id] += r.kept
    assert set(groups.values()) == {1}


def test_bayes_bound_never_prunes_what_it_should_not():
    assert jaccard.least_matches(270, 0.8, 1e-9) < 0.8 * 270 - 5 * (270 * 0.16) ** 0.5
    assert jaccard.least_matches(30, 0.8, 1e-9) > 0


def brute_lines(width):
    lines, order = [], lambda i: (i is None, i or 0)
    for n, (i, t) in enumerate(TEXTS):
        for k, line in enumerate(t.split("\n")):
            words = line.encode().split()
            if words:
                lines.append((order(i), n, k, frozenset(tuple(words[p : p + width]) for p in range(max(len(words) - width + 1, 1)))))
    gone = defaultdict(set)
    for a in lines:
        for b in lines:
            if (b[0], b[2]) < (a[0], a[2]) and len(a[3] & b[3]) >= 0.8 * len(a[3] | b[3]):
                gone[a[1]].add(a[2])
    return [gone[n] for n in range(len(TEXTS))]


#: Rows whose place in the order has no definition by id alone.
SPECIAL = (None, 407)


@pytest.mark.parametrize("width", [1, 5])
def test_lines(spark, width):
    want = brute_lines(width)
    got = line_dedup.report(frame(spark), width=width).collect()
    assert len(got) == len(TEXTS)
    assert multiset((r.doc_id, r.n_lines, tuple(r.removed)) for r in got if r.doc_id not in SPECIAL) == multiset(
        (i, len(t.split("\n")), tuple(sorted(g))) for (i, t), g in zip(TEXTS, want) if i not in SPECIAL
    )
    out = line_dedup.clean(frame(spark), width=width)
    assert out.columns == frame(spark).columns
    cleaned = {r.doc_id: r.text for r in out.where("doc_id is not null and doc_id <> 407").collect()}
    for (i, t), g in zip(TEXTS, want):
        if i not in SPECIAL and i != 400:
            assert cleaned[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)
    assert cleaned[400] is None


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring_suffix.remove_repeats(none).count() == 0
    assert substring_rlz.remove_known(none).count() == 0
    assert jaccard.join(none).count() == 0
    assert line_dedup.report(none).count() == 0 and line_dedup.clean(none).count() == 0
