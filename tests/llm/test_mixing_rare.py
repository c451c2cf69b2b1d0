"""Mixing without labels, with rare words in number, and documents that are junk and toxic."""

import random

from pyspark.sql import functions as F

from bilatera.llm import mixing
from bilatera.llm.registry import MIX

from .fixtures import SCHEMA, frame
from .test_models import LABELS


def test_without_labels_every_rate_is_one(spark):
    docs = frame(spark)
    rated, info = mixing.mix(docs, spark.createDataFrame([], LABELS), MIX)
    assert rated.count() == docs.count() and rated.where("rate <> 1 or copies <> 1").count() == 0


def test_toxic_before_junk(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, 1, 0), (4, 1, 1)], LABELS)
    assert {r["doc_id"]: r["domain"] for r in mixing.domains(labels).collect()} == {1: "toxic", 2: "junk", 3: "clean", 4: "toxic"}


def test_five_hundred_rare_toxic_words(spark):
    """No word is in 0.5 % of the labelled documents, all together tell every toxic one."""
    r = random.Random(1)
    bad = [f"bad{i}x" for i in range(500)]
    kinds = ["toxic" if i % 4 == 0 else "clean" for i in range(16_000)]
    rows = [(i, " ".join([f"w{r.randrange(80)}" for _ in range(30)] + (r.sample(bad, 4) if d == "toxic" else [])), "en", "s", 1, 1, "k", 0, "x", 9) for i, d in enumerate(kinds)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, 1, int(d == "toxic")) for i, d in enumerate(kinds) if i % 5], LABELS)
    model = mixing.train(docs, labels)
    p = mixing.posteriors(docs, model)
    at = model.names.index("toxic") if "toxic" in model.names else None
    caught = p.select("doc_id", F.col("p")[at].alias("t")).where("t > 0.5").select("doc_id").collect()
    found = {x["doc_id"] for x in caught}
    toxic = {i for i, d in enumerate(kinds) if d == "toxic"}
    assert len(found & toxic) > 0.97 * len(toxic) and len(found - toxic) < 0.02 * len(toxic)
