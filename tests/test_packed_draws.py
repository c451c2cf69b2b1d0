"""Packed draws against a row for each draw, and a step that keeps its cost per draw small."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bilatera.operators import folds
from bilatera.operators import replicates as R


@pytest.mark.parametrize("whole", [False, True])
def test_packed_counts_are_the_draws(spark, whole):
    patients = spark.range(0, 2500).select(F.format_string("K%d", "id").alias("patientId"))
    want = Counter({(r["patientId"], r["b"] + whole): r["w"] for r in folds.bootstrap_weights(patients, replicates=9, seed=3).collect()})
    if whole:
        want.update({(f"K{i}", 0): 1 for i in range(2500)})
    rows = R.packed_counts(patients, replicates=9, seed=3, with_whole=whole).toArrow()
    counts = R.decode(rows.column("counts").combine_chunks(), 9 + whole)
    got = {(p, b): int(n) for p, row in zip(rows.column("patientId").to_pylist(), counts) for b, n in enumerate(row) if n}
    assert got == dict(want) and len(set(rows.column("patientId").to_pylist())) == rows.num_rows


def test_draws_do_not_pass_the_shuffle_as_rows(spark):
    """One row of codes for a part and batch, where a row for each draw went before."""
    patients = spark.range(0, 3000).select(F.col("id").cast("string").alias("patientId"))
    plan = R.packed_counts(patients, replicates=50, seed=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "collect_list" not in plan


def test_decode_of_slices_and_wide_counts():
    import pyarrow as pa

    counts = np.array([[1, 2, 3], [0, 255, 1], [4, 5, 6]])
    rows = pa.array(R.encode(counts), pa.binary())
    assert (R.decode(rows.slice(1), 3) == counts[1:]).all()
    counts[1, 1] = 70_000
    assert (R.decode(pa.array(R.encode(counts), pa.binary()), 3) == counts).all()
