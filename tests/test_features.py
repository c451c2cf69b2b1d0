"""Cases and paired features against a direct numpy computation."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bilatera import schemas as S
from bilatera.operators import asymmetry, cases
from tests.test_functions import savgol

Q = np.linspace(2.0, 23.0, 100)


def cohort(seed=0, patients=4, reps=(3, 2), q=Q):
    rng = np.random.default_rng(seed)
    rows, m = [], 0
    for p in range(patients):
        for side, n in (("Left", reps[0]), ("Right", reps[1])):
            for _ in range(n):
                y = 1 + 0.3 * np.sin(q / 3 + p) + 0.1 * rng.normal(size=len(q)) + (0.2 if side == "Left" else 0)
                label = "CANCER" if p % 2 == 0 and side == "Left" else "BENIGN"
                rows.append((m, f"P{p}", f"P{p}_{side}", side, label, side == "Left", 50.0 + p, list(map(float, q)), list(map(float, y))))
                m += 1
    return rows


SCHEMA = ("measurement_id long, patientId string, specimenId string, side string, product_status_group string, biopsy boolean, "
          "age double, q_range array<double>, radial_profile_data array<double>")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def smooth(y):
    n = len(y)
    return y if n < 7 else savgol(y, min(11, n if n % 2 else n - 1), 3)


def direct(rows, patient, target="Left", other="Right"):
    """Feature values from the definitions, by numpy."""
    mine = sorted(r for r in rows if r[1] == patient)

    def means(lo, hi):
        axis, out = None, {target: [], other: []}
        for r in mine:
            q, y = np.array(r[7]), np.array(r[8])
            k = (q >= lo) & (q <= hi)
            if k.sum() < 5:
                continue
            q, y = q[k], smooth(y[k])
            axis = q if axis is None else axis
            out[r[3]].append(np.interp(axis, q, y))
        return axis, np.array(out[target]), np.array(out[other])

    q, t, c = means(6.7, 23.0)
    qf, tf, cf = means(2.0, 23.0)
    a, b, sa, sb = t.mean(0), c.mean(0), t.std(0, ddof=1), c.std(0, ddof=1)
    v, d = sa**2 + sb**2, a - b
    out = {}
    for k, m in (("1", (q >= 6.7) & (q <= 15)), ("2", (q >= 15) & (q <= 23))):
        w = 1 / np.maximum(v[m], np.percentile(v[m], 5) + 1e-12)
        out[f"sk_meanrms{k}"] = np.sqrt(np.mean(d[m]**2))
        out[f"sk_weightedrms{k}"] = np.sqrt((w * d[m]**2).sum() / w.sum())
        out[f"sk_sigma_target{k}"] = np.sqrt(np.mean(sa[m]**2))
        out[f"sk_sigma_contralateral{k}"] = np.sqrt(np.mean(sb[m]**2))
        out[f"sk_mahalanobis{k}"] = np.sqrt((d[m]**2 / (v[m] + 1e-12)).sum())
    z = (q >= 13.5) & (q <= 14.5)
    out["sk_peak14_intensity_abs_delta"] = abs(a[z].max() - b[z].max())
    peak = lambda s: np.mean([np.array(r[8])[(np.array(r[7]) >= 13) & (np.array(r[7]) <= 14.8)].max() for r in mine if r[3] == s])
    out["sk_mean_peak_value_abs_delta"] = abs(peak(target) - peak(other))
    cos = lambda x, y: 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    emd = lambda q, x, y: np.sum(np.abs(np.cumsum(x / x.sum())[:-1] - np.cumsum(y / y.sum())[:-1]) * np.diff(q))
    out["sk_wasserstein_distance_mu_tc"] = emd(q, a, b)
    out["sk_cosine_distance_full_q2"] = cos(tf.mean(0), cf.mean(0))
    out["sk_wasserstein_distance_full_q2"] = emd(qf, tf.mean(0), cf.mean(0))
    raw = {s: [np.array(r[8]) for r in mine if r[3] == s] for s in (target, other)}
    within = {s: np.mean([cos(x, y) for i, x in enumerate(v) for y in v[i + 1:]]) for s, v in raw.items()}
    out["target_within_cosine_distance_mean"] = within[target]
    out["contralateral_within_cosine_distance_mean"] = within[other]
    between = cos(np.mean(raw[target], 0), np.mean(raw[other], 0))
    out["between_breasts_cosine_distance_mean"] = between
    out["symmetry_cosine_score"] = between - np.mean(list(within.values()))
    return out


def features(spark, rows, **kw):
    df = frame(spark, rows)
    c = cases.target_cases(df)
    return {r["target_case_id"]: r for r in asymmetry.pair_features(c, asymmetry.side_profiles(df, **kw)).collect()}


@pytest.mark.parametrize("shared", [True, False])
def test_pair_features_match_numpy(spark, shared):
    rows = cohort()
    got = features(spark, rows, shared_axis=shared)
    assert sorted(got) == [f"P{p}::LEFT" for p in range(4)]
    for case, r in got.items():
        for name, want in direct(rows, case[:2]).items():
            assert r[name] == pytest.approx(want, abs=1e-9), name
        assert r["symmetry_available"] == 1 and r["symmetry_reason"] == ""


def test_rows_on_different_axes_use_the_first_row(spark):
    rows = cohort(patients=2)
    other = np.linspace(2.0, 23.0, 90)
    k = 3
    rows[k] = (*rows[k][:7], list(map(float, other)), list(map(float, np.interp(other, Q, rows[k][8]))))
    got = features(spark, rows)["P0::LEFT"]
    names = [n for n in S.PAIR_FEATURES]
    # Raw mean profiles of unequal length are outside the definition; the smoothed features are not.
    mine = [r for r in rows if r[1] == "P0"]
    assert len({len(r[7]) for r in mine}) == 2
    want = None
    try:
        want = direct(rows, "P0")
    except ValueError:
        pass
    if want:
        for n in names:
            assert got[n] == pytest.approx(want[n], abs=1e-9), n
    assert got["symmetry_available"] == 1


def test_gate_reasons(spark):
    rows = [r for r in cohort(patients=3) if not (r[1] == "P1" and r[3] == "Right")]
    keep = [r for r in rows if r[1] == "P2" and r[3] == "Right"][:1]
    rows = [r for r in rows if not (r[1] == "P2" and r[3] == "Right")] + keep
    got = features(spark, rows)
    assert got["P1::LEFT"]["symmetry_reason"] == "contralateral_breast_unavailable"
    assert got["P2::LEFT"]["symmetry_reason"] == "fewer_than_2_valid_measurements_per_breast"
    assert all(got["P1::LEFT"][c] == 0.0 for c in S.PAIR_FEATURES)


def test_core4_not_computable_on_a_short_axis(spark):
    rows = cohort(patients=1, q=np.linspace(2.0, 6.0, 30))
    r = features(spark, rows)["P0::LEFT"]
    assert (r["symmetry_available"], r["symmetry_reason"]) == (0, "sk_core4_not_computable")
    assert all(r[c] == 0.0 for c in S.PAIR_FEATURES)


def test_hot_patient_is_aggregated_exactly(spark):
    """One patient holding most rows gives the same result as numpy."""
    rows = cohort(patients=1, reps=(150, 120))
    got = features(spark, rows, shared_axis=True)["P0::LEFT"]
    for name, want in direct(rows, "P0").items():
        assert got[name] == pytest.approx(want, abs=1e-8), name


def test_ambiguous_side_fails(spark):
    rows = cohort(patients=1)
    rows[0] = (*rows[0][:4], "BENIGN", *rows[0][5:])
    with pytest.raises(PySparkException, match="ambiguous"):
        cases.target_cases(frame(spark, rows)).collect()


def test_logit_average(spark):
    df = spark.createDataFrame([(0.95,), (0.95,), (0.50,)], "p double")
    r = df.agg(cases.logit_average(F.col("p")).alias("a"), F.avg("p").alias("m")).first()
    assert r["a"] == pytest.approx(0.877, abs=1e-3) and r["m"] == pytest.approx(0.80)
    assert df.where("p > 2").agg(cases.logit_average(F.col("p")).alias("a")).first()["a"] == 0.5


def test_contralateral_side_kept_without_biopsy(spark):
    got = {r["target_case_id"]: r for r in cases.target_cases(frame(spark, cohort(patients=1))).collect()}
    assert got["P0::LEFT"]["contralateral_side"] == "Right" and got["P0::LEFT"]["label"] == 1
