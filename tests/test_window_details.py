"""Window centres in the calibration detail."""

import json

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_window_details_hold_the_centres(spark):
    rows = entry.queries()["k6_window_details"](spark, SF).where("peak_window_details is not null").collect()
    assert rows
    for r in rows:
        for w in json.loads(r["peak_window_details"]):
            assert w["alpha_q"] - w["beta_q"] > 0 and abs(w["right_control_q"] + w["beta_q"] - 2 * w["alpha_q"]) < 1e-9
            assert {"ord", "left_area", "right_control_area"} <= set(w)
