"""The pixel route evaluates what concerns rows once per row, never per pixel."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_geometry_is_not_read_per_pixel(spark):
    out = entry.queries()["u1_pixel_route"](spark, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" in "".join(out.inputFiles()) and "str_to_map" not in plan
