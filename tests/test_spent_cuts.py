"""Tables of earlier cuts go when they are spent, and nothing else does."""

import os

import pytest

from bilatera.sources import storage


def folder(table):
    return table.inputFiles()[0].rsplit("/", 1)[0].split(":", 1)[1].replace("//", "/")


def test_spent_table_goes_after_the_write(spark):
    first = storage.cut_lineage(spark.range(10))
    other, at = storage.cut_lineage(spark.range(3)), folder(first)
    then = storage.cut_lineage(first.where("id > 4"), spent=[first])
    assert not os.path.exists(at) and then.count() == 5 and other.count() == 3


def test_only_cut_tables_go(spark, tmp_path):
    spark.range(4).write.parquet(f"{tmp_path}/mine")
    mine = spark.read.parquet(f"{tmp_path}/mine")
    with pytest.raises(ValueError, match="cut_lineage"):
        storage.cut_lineage(spark.range(2), spent=[mine])
    assert mine.count() == 4


def test_known_words_leave_no_marks_behind(spark, tmp_path, monkeypatch):
    from bilatera.llm import substring_rlz

    monkeypatch.setattr(storage, "new_path", lambda spark, name, n=iter(range(99)): f"{tmp_path}/{name}-{next(n)}")
    words = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, f"{words} only{i}") for i in range(4)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_rlz.remove_known(df).collect()}
    assert got == {0: 0, 1: 40, 2: 40, 3: 40}
    # What the last plan reads: joined stretches and the parts to compare.
    assert len(os.listdir(tmp_path)) == 2
