"""The mixing stage keeps clean text however much unwanted text comes with it, and bounds the unwanted shares."""

import random

import pytest

import corpus_pipeline as pipeline
from tests.llm.fixtures import SCHEMA
from tests.llm.test_models import LABELS

OWN = {"clean": ["sun", "sea"], "toxic": ["awful", "vile"], "junk": ["!!!", "$$$"]}


@pytest.mark.parametrize("toxic,junk", [(0, 0), (1, 1), (5, 5), (20, 20), (0, 20), (20, 1), (1, 0)])
def test_clean_stays_and_bounds_hold(spark, tmp_path, toxic, junk):
    r = random.Random(toxic * 100 + junk)
    n = 3000
    kinds = ["toxic"] * (n * toxic // 100) + ["junk"] * (n * junk // 100)
    kinds += ["clean"] * (n - len(kinds))
    r.shuffle(kinds)
    word = lambda d: r.choice(OWN[d] if r.random() < 0.4 else [f"w{k}" for k in range(60)])
    rows = [(i, " ".join(word(d) for _ in range(40)), "en", "s", 1, 1, "k", 0, "x", 9) for i, d in enumerate(kinds)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    marks = [(i, int(d != "junk"), int(d == "toxic")) for i, d in enumerate(kinds) if i % 3]
    spark.createDataFrame(marks, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    kept = {x.doc_id for x in pipeline.mix_sources(spark, docs, str(tmp_path)).select("doc_id").collect()}
    count = lambda d, ids: sum(kinds[i] == d for i in ids)
    assert count("clean", kept) >= 0.998 * count("clean", range(n))
    for d, bound in (("toxic", 0.035), ("junk", 0.015)):
        have = count(d, range(n))
        # Documents are of one length; a draw by hash strays by about its square root.
        assert count(d, kept) <= bound * len(kept) + 3 * (bound * len(kept)) ** 0.5
        if have <= 0.9 * bound * n:
            assert count(d, kept) >= 0.9 * have
        elif have:
            assert count(d, kept) >= 0.3 * bound * len(kept)
