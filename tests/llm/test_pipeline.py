"""The stages on a small folder of tables, each held against its definition on its own input."""

import corpus_pipeline as pipeline
from bilatera.llm import registry
from tests.llm.fixtures import SCHEMA, corpus, frame
from tests.llm.test_models import labels


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    frame(spark).write.parquet(f"{folder}/documents.parquet")
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]
    sizes = []
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        before, out = docs, stage(spark, docs, folder)
        assert out.columns == before.columns and out.dtypes == before.dtypes, name
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        sizes.append(docs.count())
        if name in ("quality_classifier", "ngram_jaccard_join", "mixing"):
            assert docs.exceptAll(before).count() == 0  # a subset, unchanged
    assert sizes[0] == len([r for r in corpus() if r[1]]) or 0 < sizes[0] < len(corpus())
    assert sizes[2] < sizes[1] == sizes[0]
    words = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    last = pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in last.collect()} == set(words)
    got = pipeline.run(spark, folder)
    assert got.count() == last.count() and got.columns == last.columns


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    assert pipeline.run(spark, folder).count() == 0


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 11))
    assert set(registry.SQL) <= set(registry.QUERIES)
