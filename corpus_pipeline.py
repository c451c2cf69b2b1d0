"""Training-corpus pipeline: quality, line dedup, near-duplicates, mixing, packing.

Every stage takes the documents its predecessor kept, with the columns of ``documents``, and works on all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bilatera.llm import jaccard, line_dedup, mixing, packing, quality
from bilatera.llm import windows as W
from bilatera.llm.registry import modest_batches
from bilatera.sources.storage import cut_lineage

#: Shares of expected tokens, upper bounds for all but clean. Soft posteriors of clean text hold a little of the other domains, so these are not zero.
TARGETS = {"clean": 0.95, "toxic": 0.035, "junk": 0.015}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose row key is in ``keys``."""
    found = W.under_row_key(keys).distinct()
    return W.with_row_key(docs).join(found, list(W.ROW_KEY), "left_semi")


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text does not reject."""
    modest_batches(spark)
    return _columns(_only(docs, quality.judge(docs, _labels(spark, sf_dir)).where("kept")), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose words repeat an earlier one's; ``n_chars`` follows the text where there is such a column."""
    modest_batches(spark)
    out = line_dedup.clean(docs, width=1)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id. Rows equal in id and text are one."""
    modest_batches(spark)
    kept = jaccard.join(docs).where("kept")
    return _columns(_only(docs, kept).dropDuplicates(list(W.ROW_KEY)), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are most likely clean, and of the others as many copies as their fitted rates say, at most one."""
    modest_batches(spark)
    rated, _ = mixing.limit(docs, _labels(spark, sf_dir), TARGETS, "clean")
    return _columns(_only(docs, rated.where("copies > 0")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens."""
    modest_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted model decides, which SQL does not express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
