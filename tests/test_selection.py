"""Selections as datasets with a record, file digests of inputs, and the pixel steps of a route."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bilatera.operators import calibration
from bilatera.plans import routes
from bilatera.sources import storage

SF = "/root/testdata/sf0.001"


def scored(spark):
    rows = [("a", "2025-01-01 10:00:00", True), ("b", "2025-01-02 10:00:00", False), ("b", "2025-01-02 11:00:00", False),
            ("c", "2025-01-01 12:00:00", False), (None, "2025-01-05 10:00:00", True), ("d", None, True)]
    return spark.createDataFrame(rows, "session_uid string, t string, pass boolean").withColumn("started_at", F.to_timestamp("t"))


def test_selection_round_trip(spark, tmp_path):
    path = str(tmp_path / "s")
    calibration.write_selection(scored(spark), path, parameters={"max_score": 0.1})
    record, lists = calibration.read_selection(spark, path)
    assert {k: sorted(r["value"] for r in v.collect()) for k, v in lists.items()} == {
        "accepted_dates": ["2025-01-01", "2025-01-05"], "accepted_session_uids": ["a", "d"],
        "rejected_dates": ["2025-01-01", "2025-01-02"], "rejected_session_uids": ["b", "c"]}
    assert record["selection"]["rows_total"] == 6 and record["h5_id_filter"]["list"] == "accepted_session_uids"
    rows = spark.createDataFrame(
        [(1, "a", "2025-01-02"), (2, "b", "2025-01-09"), (3, None, "2025-01-02"), (4, None, "2025-01-05"), (5, "x", "2025-01-02"), (6, None, None)],
        "id int, linked_agbh_session_uid string, d string").withColumn("started_on", F.to_date("d"))
    assert {r["id"] for r in calibration.exclude_rejected(rows, path).collect()} == {1, 4, 5, 6}


def test_changed_list_is_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    calibration.write_selection(scored(spark), path, parameters={"max_score": 0.1})
    spark.createDataFrame([("z",)], "value string").write.mode("overwrite").parquet(f"{path}/lists/list=rejected_session_uids")
    with pytest.raises(ValueError, match="rejected_session_uids"):
        calibration.read_selection(spark, path)


def test_selection_without_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    calibration.write_selection(scored(spark).limit(0), path, parameters={"max_score": 0.1})
    record = spark.read.json(f"{path}/record").first()
    assert record["selection"]["rows_total"] == 0 and record["lists"]["accepted_dates"]["n"] == 0


def test_input_digest_follows_content_not_names(spark, tmp_path):
    for folder, names in (("a", "xy"), ("b", "qp")):
        (tmp_path / folder).mkdir()
        for n, text in zip(names, ("one", "two!")):
            (tmp_path / folder / f"{n}.txt").write_text(text)
    want = hashlib.sha256("\n".join(sorted(f"{len(t)}:{hashlib.sha256(t.encode()).hexdigest()}" for t in ("one", "two!"))).encode()).hexdigest()
    assert storage.input_sha256(spark, str(tmp_path / "a")) == want == storage.input_sha256(spark, str(tmp_path / "b"))
    (tmp_path / "b" / "q.txt").write_text("One")
    assert storage.input_sha256(spark, str(tmp_path / "b")) != want


def test_pixel_steps_mark_the_pixel_table(spark):
    px = spark.createDataFrame([(1, 5.0, 10.0, 0.5), (1, 5.0, 900.0, 0.5), (1, 5.0, 900.0, 0.01)], "measurement_id long, q double, counts double, radius double")
    steps = {s.name: s for s in routes.build_steps(routes.prediction_policy(), pixels=px)}
    assert steps["faulty_pixels"].table == "pixels" and steps["azimuthal_integration"].table == "both"
    rows = spark.createDataFrame([(1, 2.0, 4.0, [0.0], [0.0])], "measurement_id long, sample_thickness_mm double, calibrant_thickness_mm double, q_range array<double>, radial_profile_data array<double>")
    out = routes.run_steps(rows, [steps["faulty_pixels"], steps["azimuthal_integration"]]).first()
    assert out["radial_profile_data"] == [pytest.approx((10 + 900) / 2 * 2.0)]


def test_pixel_route_keeps_rows(spark):
    assert entry.queries()["u1_pixel_route"](spark, SF).count() > 10


def test_run_scope_removes_its_folder(spark):
    import os

    with storage.run_scope(spark):
        path = storage.new_path(spark, "x")
        inner = storage.cut_lineage(spark.range(5))
        assert inner.count() == 5 and "run-" in path
        folder = os.path.dirname(path.removeprefix("file:"))
        assert os.listdir(folder)
    assert not os.path.exists(folder) and "run-" not in storage.new_path(spark, "x")
