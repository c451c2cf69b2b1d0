"""Audit rows of every field."""

import __spark_entry__ as entry
from bilatera.plans import queries
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"


def test_mismatch_rows_cover_all_fields(spark):
    q = entry.queries()["j2_mismatch_fields"]
    assert compare(spark, connect(SF), q, entry.oracle_sql()["j2_mismatch_fields"], SF) == "ok"


def test_mismatch_rows_of_numbers_and_text(spark, monkeypatch):
    made = lambda rows: spark.createDataFrame(rows, "external_id string, measurement_id long, age double, thickness double, status string")
    left = made([("a", 1, 40.0, 2.5, "BENIGN"), ("b", 2, 41.0, None, "NORMAL"), ("c", 3, 42.0, 1.0, "NORMAL")])
    right = made([("a", 1, 41.0, 2.5, "CANCER"), ("b", 2, 41.0, 3.25, None), ("d", 3, 42.0, 1.0, "NORMAL")])
    monkeypatch.setattr(queries.V, "meta_left", lambda *_: left)
    monkeypatch.setattr(queries.V, "meta_right", lambda *_: right)
    assert {tuple(r) for r in entry.queries()["j2_mismatch_fields"](spark, SF).collect()} == {
        ("a", "age", "40.000000", "41.000000"), ("a", "status", "BENIGN", "CANCER"),
        ("b", "thickness", None, "3.250000"), ("b", "status", "NORMAL", None)}
