"""Language of every text against one text at a time with plain loops; many short texts; extra columns."""

import math
import random

from bilatera.llm import language

from .fixtures import SCHEMA


def corpus(n=240):
    r = random.Random(4)
    sounds = {"aa": ["ka", "to", "mi", "zu"], "bb": ["sch", "ein", "der", "ung"], "cc": ["qué", "ción", "los", "ña"]}
    rows = []
    for i in range(n):
        lang = r.choice(sorted(sounds))
        text = " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(2, 30)))
        rows.append((i, text, lang, "s", 1, 1, "k", 0, "x", 9))
    return rows + [(900, None, None, "s", 1, 1, "k", 0, "x", 9), (901, "12 34 !!", "aa", "s", 1, 1, "k", 0, "x", 9), (901, "12 34 !!", "aa", "s", 1, 1, "k", 0, "x", 9)]


def alone(text, model):
    """Cosine of one text with every centroid, weights and sums by hand."""
    counts = language.term_counts([text])[0]
    at = [i for i, c in enumerate(counts) if c]
    v = {i: math.log1p(float(counts[i])) * float(model.idf[i]) for i in at}
    size = math.sqrt(sum(x * x for x in v.values())) or 1.0
    scores = [sum(x * float(c[i]) for i, x in v.items()) / size for c in model.centres]
    best = max(range(len(scores)), key=lambda j: scores[j])
    return model.languages[model.owner[best]], min(max(scores[best], 0.0), 1.0)


def test_predictions_one_by_one(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = language.fit(df)
    got = {(r["doc_id"], r["lang_pred"]): r for r in language.predict(df, model).collect()}
    right = 0
    for i, text, lang, *_ in rows:
        if text is None or not any(c.isalpha() for c in text):
            assert got[i, "und"]["score"] == 0
            continue
        want, score = alone(text, model)
        assert abs(got[i, want]["score"] - score) < 1e-4
        right += want == lang
    assert right > 230 and language.predict(df, model).count() == len(rows)


def test_many_short_texts_stay_small(spark):
    """Dense counts are held for a bounded number of texts, whatever their length."""
    from bilatera.llm import numeric as N
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["ab"] * 10_000)], names=["text"])
    assert max(b.num_rows for b in N.slices(iter([batch]), "text", rows=language.ROWS)) == language.ROWS
    df = spark.range(20_000).selectExpr("id doc_id", "'ab' text", "'aa' lang").coalesce(1)
    assert language.predict(df, language.fit(df)).groupBy("lang_pred").count().collect() == [("aa", 20_000)]
