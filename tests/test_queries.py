"""Registered queries against their SQL twins at the smallest scale, and the driver contract."""

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
# One query per family keeps the suite short; tools/compare.py runs all of them.
KEYS = (
    "case_table", "a3_calibration_manifest", "b1_predicates", "b12_pair_filter", "b27_container_check", "c4_azimuthal_integration",
    "c12_smoothing", "c18_peak_height", "c19_side_profiles", "d12_availability_gate", "d13_legacy_contract", "e5_reliability",
    "e8_batch_scores", "f3_fold_membership", "g4_score_percentiles", "m4_roc_points", "m16_tier_policy", "k5_reference_fit",
    "k6_left_shoulder", "j2_reconciliation", "u1_step_chain", "m10_fit_record", "m22_internal_report", "u1_pixel_route",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, con, key):
    assert compare(spark, con, entry.queries()[key], entry.oracle_sql()[key], SF) == "ok"


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    df = entry.entry(spark)
    assert "target_case_id" in df.columns and df.count() == 65
