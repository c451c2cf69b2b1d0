"""Packing: ids, cuts, gapless sequences, and few of them."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bilatera.llm import packing
from tests.llm.fixtures import SCHEMA, corpus, frame

PATHS = packing.vocabulary()
EXACT = Tokenizer.from_file(PATHS[0])


def ids(text):
    return [*EXACT.encode(text or "", add_special_tokens=False).ids, packing.END]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_fast_ids_are_the_tokenizers(text):
    assert packing.encode(text, PATHS) == ids(text)[:-1]


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b", "  \n\t x  y", "'s 12345 ½ ñ́ \U0001f600", "z" * 3000])
def test_special_texts(text):
    assert packing.encode(text, PATHS) == ids(text)[:-1]


@pytest.mark.parametrize("shard", [50_000, 7])
def test_pack(spark, shard):
    rows = corpus()
    got = packing.pack(frame(spark), 64, shard=shard).collect()
    by_row, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by_row[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    twice = {None, 407}
    for i, text, *_ in rows:
        if i in twice:
            continue
        at, tokens = 0, np.array(ids(text), "<u4")
        for k, r in enumerate(sorted(by_row[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 64 or k == 0)
            assert r.ids_crc32 == zlib.crc32(tokens[at : at + r.length].tobytes())
            at += r.length
        assert at == len(tokens)
    assert sum(r.length for r in got) == sum(len(ids(r[1])) for r in rows)
    if shard > 7:
        assert len(sequences) <= 1.05 * sum(r.length for r in got) / 64 + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rule():
    """Every item goes where the sum of squared counts becomes smallest among bins with room."""
    sizes = np.random.default_rng(0).integers(1, 30, 400)[::-1].copy()
    sizes = -np.sort(-sizes)
    place, offset, bins = packing.sum_of_squares(sizes, 30)
    fill, opened = {}, 0
    for size, at, off in zip(sizes, place, offset):
        gaps = [30 - f for f in fill.values() if f < 30]
        before = {b: 30 - f for b, f in fill.items()}

        def total(b):
            left = dict(before)
            left[b] = left.get(b, 30) - size
            counts = np.bincount([g for g in left.values() if g > 0], minlength=31)
            return int((counts.astype(np.int64) ** 2).sum())

        fits = [b for b, g in before.items() if g >= size]
        if fits:
            assert at in fits and total(at) == min(total(b) for b in {before[f]: f for f in fits}.values())
        else:
            assert at not in before
            opened += 1
        assert off == fill.get(at, 0)
        fill[at] = fill.get(at, 0) + size
        assert len(gaps) <= len(fill)
    assert bins == opened
