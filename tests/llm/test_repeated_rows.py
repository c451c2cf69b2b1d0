"""Rows equal in id and text in number: work and lists do not grow with their pairs, results are those of brute force."""

import hashlib
import time

from bilatera.llm import substring_rlz, substring_suffix

from .fixtures import SCHEMA


def rows(copies, tail=()):
    text = " ".join(f"w{i} of {i % 7}" for i in range(150))
    return [(1, text, "en", "s", 1, 1, "k", 0, "x", 9)] * copies + [(i, t, "en", "s", 1, 1, "k", 0, "x", 9) for i, t in tail], text


def test_thousands_of_equal_rows(spark):
    table, text = rows(5000, [(2, "x " * 40 + " ".join(f"w{i} of {i % 7}" for i in range(60, 120))), (3, "alone in the world")])
    df = spark.createDataFrame(table, SCHEMA).repartition(8)
    start = time.time()
    got = substring_suffix.remove_repeats(df).groupBy("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 3 and by[1]["count"] == 5000 and by[1]["n_removed"] == by[1]["n_bytes"] == len(text.encode()) and by[1]["n_spans"] == 1
    assert by[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and by[2]["n_removed"] > 300 and by[3]["n_removed"] == 0
    known = substring_rlz.remove_known(df).groupBy("doc_id", "n_words", "n_removed").count().collect()
    by = {r["doc_id"]: r for r in known}
    # Rows of one doc_id are no reference for each other.
    assert by[1]["count"] == 5000 and by[1]["n_removed"] == 0 and by[2]["n_removed"] == 180 and by[3]["n_removed"] == 0
    assert time.time() - start < 90


def test_lists_do_not_grow_with_copies(spark):
    sizes = []
    for copies in (20, 400):
        table, _ = rows(copies, [(2, " ".join(f"w{i} of {i % 7}" for i in range(40, 90)))])
        df = spark.createDataFrame(table, SCHEMA).repartition(4)
        sizes.append((substring_suffix.spans(df).count(), substring_rlz.phrases(df).count()))
    assert sizes[0] == sizes[1]
