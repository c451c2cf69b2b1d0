"""Filters on the eight-row container, signal steps, calibration study, audits, storage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bilatera.operators import audits, calibration, filters, signal
from bilatera.operators.filters import Predicate
from bilatera.plans import routes
from bilatera.sources import reference, storage

Q = [float(v) for v in np.linspace(2.0, 23.0, 100)]


def container(spark):
    """Eight rows, five patients; rows 1, 2, 4, 5, 7 survive the training route."""
    rows = [
        (1, "P1", "Left", "BENIGN", True, 50.0, 40.0), (2, "P1", "Right", "CANCER", True, 50.0, 40.0),
        (3, "P2", "Left", "BENIGN", False, 50.0, 40.0), (4, "P3", "Left", "NORMAL", False, 50.0, 40.0),
        (5, "P3", "Right", "ATYPICAL", True, 50.0, 40.0), (6, "P4", "Left", "BENIGN", False, None, 40.0),
        (7, "P4", "Right", "CANCER", True, 50.0, 40.0), (8, "P5", "Left", "CANCER", True, 50.0, 50.0),
    ]
    y = [3.0 + float(np.sin(v)) for v in Q]
    return spark.createDataFrame(
        [(m, p, f"{p}_{s}", s, "P1", st, b, 60.0, t, c, 25.0, None, None, Q, y) for m, p, s, st, b, t, c in rows],
        "measurement_id long, patientId string, specimenId string, side string, position string, specimen_status string, "
        "biopsy boolean, age double, sample_thickness_mm double, calibrant_thickness_mm double, poni_q_max_nm_inv double, "
        "started_on date, linked_agbh_session_uid string, q_range array<double>, radial_profile_data array<double>",
    )


def test_training_route_survivors(spark):
    policy = routes.training_policy(gate=0.0, columns=("measurement_id", "patientId", "product_status_group", "radial_profile_data", "q_range"))
    out = routes.run_steps(container(spark), routes.build_steps(policy)).collect()
    got = {r["measurement_id"]: r["product_status_group"] for r in out}
    assert got == {1: "BENIGN", 2: "CANCER", 4: "BENIGN", 5: "CANCER", 7: "CANCER"}
    for r in out:
        q, y = np.array(r["q_range"]), np.array(r["radial_profile_data"])
        assert np.median(y[(q >= 6.7) & (q <= 7.1)]) == pytest.approx(1.0)


def test_prediction_route_keeps_unlabelled_patients(spark):
    policy = routes.prediction_policy(gate=0.0, columns=("measurement_id", "patientId"))
    out = routes.run_steps(container(spark), routes.build_steps(policy)).collect()
    assert {r["measurement_id"] for r in out} == {1, 2, 3, 4, 5, 7}


def test_route_with_pixels(spark):
    rng = np.random.default_rng(0)
    px = [(m, float(q), float(rng.poisson(200 + 50 * np.sin(q))), float(r)) for m in (1, 2, 4, 5, 7)
          for q, r in zip(rng.uniform(2, 23, 4000), rng.uniform(0, 1, 4000))]
    pixels = spark.createDataFrame(px, "measurement_id long, q double, counts double, radius double")
    policy = routes.training_policy(gate=0.0, columns=("measurement_id", "snr_db", "radial_profile_data"))
    out = routes.run_steps(container(spark), routes.build_steps(policy, pixels=pixels)).collect()
    assert {r["measurement_id"] for r in out} == {1, 2, 4, 5, 7} and all(r["snr_db"] > 18 for r in out)
    assert all(len(r["radial_profile_data"]) == 100 for r in out)


def test_exclusion_lists_as_tables_equal_literals(spark):
    df = spark.createDataFrame(
        [(1, "a", "2025-01-01"), (2, "b", "2025-01-02"), (3, None, "2025-01-01"), (4, None, "2025-01-02"), (5, None, None)],
        "id int, linked_agbh_session_uid string, d string").withColumn("started_on", F.to_date("d"))
    ids, days = ["a"], ["2025-01-02"]
    lit = filters.exclude_sessions(df, ids, days)
    tab = filters.exclude_sessions(df, spark.createDataFrame([(v,) for v in ids], "x string"), spark.createDataFrame([(v,) for v in days], "x string"))
    want = {2, 3, 5}
    assert {r["id"] for r in lit.collect()} == want and {r["id"] for r in tab.collect()} == want


def test_unknown_operator_and_duplicate_columns(spark):
    with pytest.raises(ValueError):
        filters.predicate(Predicate("a", "like", value="x"))
    with pytest.raises(ValueError):
        filters.keep_columns(container(spark), ["patientId", "patientId"])
    with pytest.raises(KeyError):
        filters.keep_columns(container(spark), ["absent"])


def test_two_class_guard_names_the_counts(spark):
    df = container(spark).withColumn("product_status_group", F.lit("BENIGN"))
    with pytest.raises(ValueError, match="benign_rows"):
        filters.require_two_classes(filters.stage1_rows(df))


def test_profile_validation(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "radial_profile_data array<double>")
    with pytest.raises(ValueError, match="equal length"):
        signal.require_profiles(df)
    bad = spark.createDataFrame([([1.0, float("nan")],)], "radial_profile_data array<double>")
    with pytest.raises(ValueError, match="non-finite"):
        signal.require_profiles(bad)


def test_scan_pushes_filters_and_prunes_columns(spark):
    path = storage.new_path(spark, "scan")
    container(spark).write.parquet(path)
    df = storage.scan_measurements(spark, path, [Predicate("poni_q_max_nm_inv", ">=", value=23.0)]).select("patientId")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "IsNotNull(sample_thickness_mm)" in plan and "GreaterThanOrEqual(poni_q_max_nm_inv,23.0)" in plan
    assert "radial_profile_data" not in plan
    assert df.count() == 7


def test_artifact_lineage_is_required(spark):
    df = spark.range(3)
    ok = storage.write_artifact(df, storage.new_path(spark, "a"), config_text="{}", input_sha256="x")
    assert storage.read_artifact(spark, ok).count() == 3
    broken = storage.write_artifact(df, storage.new_path(spark, "a"), config_text="", input_sha256="x")
    with pytest.raises(ValueError):
        storage.read_artifact(spark, broken)


def test_file_checksum(spark, tmp_path):
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abc" * 1000)
    r = storage.file_checksums(spark, str(tmp_path)).first()
    assert r["sha256"] == hashlib.sha256(b"abc" * 1000).hexdigest()
    assert storage.file_checksums(spark, str(tmp_path), block=7).first()["sha256"] == r["sha256"]


def test_batch_rule_for_rows_without_batch(spark):
    rows = spark.createDataFrame([("7",), ("6",), (None,), ("9",)], "data_batch string")
    got = {r["data_batch"]: r["batch_policy"] for r in calibration.batch_policy(rows, reference.batch_rules(spark)).collect()}
    assert got == {"7": "use", "6": "exclude", None: "review", "9": "review"}


def test_effective_thickness_boundary(spark):
    df = spark.createDataFrame([("2026-04-30 23:59:59",), ("2026-05-01 00:00:00",), (None,)], "s string").withColumn(
        "started_at", F.try_to_timestamp("s"))
    got = [r["agbh_calibrant_thickness_mm"] for r in calibration.effective_thickness(df).orderBy("s").collect()]
    assert got == [None, 40.0, 10.0]


def calibrants(spark, n=6):
    rng = np.random.default_rng(11)
    grid = np.linspace(2.0, 23.0, 400)
    rows = []
    for k in range(n):
        y = np.exp(-((grid - 9.0) ** 2)) + 0.2 * np.exp(-((grid - 15.0) ** 2) * 4) + 0.02 * rng.random(400)
        rows.append((k, f"s{k}", "7", f"{k}.h5", [float(v) for v in grid], [float(v) for v in y]))
    return spark.createDataFrame(rows, "vec_id long, session_uid string, data_batch string, file_name string, q_range array<double>, radial_profile_data array<double>").withColumn("started_on", F.lit("2026-01-01").cast("date"))


def norm(v):
    v = v - v.min()
    return v / v.max()


@pytest.mark.parametrize("shifts", [(0.0,), (-0.04, -0.013, 0.0, 0.02)])
def test_left_shoulder_matches_numpy(spark, shifts):
    df = calibrants(spark)
    ref = df.where("vec_id >= 4")
    got = {r["vec_id"]: r for r in calibration.left_shoulder_metric(df, ref, q_min=2.0, q_max=23.0, points=900, shifts=shifts).collect()}
    grid = np.linspace(2.0, 23.0, 900)
    ys = {r["vec_id"]: norm(np.interp(grid, r["q_range"], r["radial_profile_data"])) for r in df.collect()}
    curve = np.median([ys[4], ys[5]], axis=0)
    mask = calibration.fit_mask(grid, 2.0, 23.0)
    cq = grid - grid.mean()
    wins = calibration.peak_windows(2.0, 23.0)
    for k, y in ys.items():
        best = None
        for s in shifts:
            moved = np.interp(grid - s, grid, curve, left=np.nan, right=np.nan)
            ok = mask & np.isfinite(moved)
            a = np.column_stack([moved[ok], np.ones(ok.sum()), cq[ok]])
            x = np.linalg.lstsq(a, y[ok], rcond=None)[0]
            mse = np.mean((y[ok] - a @ x) ** 2)
            if best is None or mse < best[0]:
                best = (mse, s, x, x[0] * moved + x[1] + x[2] * cq)
        res = y - best[3]

        def area(c):
            m = (grid >= c - 0.12) & (grid <= c + 0.12)
            return np.trapezoid(np.clip(res[m], 0, None), grid[m])

        left, right = sum(area(w[2]) for w in wins), sum(area(w[3]) for w in wins)
        r = got[k]
        assert r["reference_q_shift_nm_inv"] == pytest.approx(best[1])
        assert [r["reference_fit_scale"], r["reference_fit_offset"], r["reference_fit_linear_background"]] == pytest.approx(list(best[2]), abs=1e-6)
        assert r["kbeta_left_positive_area"] == pytest.approx(left, abs=1e-7) and r["right_control_positive_area"] == pytest.approx(right, abs=1e-7)
        assert r["kbeta_left_net_area"] == pytest.approx(max(left - right, 0), abs=1e-7)


def test_reconcile_counts_duplicates(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", None), (4, "c", 1.0)], "m int, k string, v double")
    right = spark.createDataFrame([(1, "a", 1.0), (2, "b", 3.0), (3, "d", 1.0)], "m int, k string, v double")
    r = audits.reconcile(left, right, key="k", order="m", fields=("v",)).first()
    assert (r["left_rows"], r["left_keys"], r["left_duplicate_keys"], r["matched_keys"], r["left_only_keys"], r["right_only_keys"], r["mismatch_rows"]) == (4, 3, 1, 2, 1, 1, 1)
    m = audits.mismatches(left, right, key="k", order="m", fields=("v",)).collect()
    assert [(x["k"], x["left_value"], x["right_value"]) for x in m] == [("b", None, "3.0")]


def test_backfill_numeric_only(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 5.0), (4, None)], "id int, t double")
    fix = spark.createDataFrame([(1, "40.0"), (2, " "), (3, "9")], "id int, new_value string")
    out = audits.backfill(df, fix, key="id", column="t")
    assert {r["id"]: r["t"] for r in out.collect()} == {1: 40.0, 2: None, 3: 5.0, 4: None}
    s = audits.backfill_summary(out, "t").first()
    assert (s["missing_before"], s["backfilled_rows"], s["missing_after"]) == (3, 1, 2)
