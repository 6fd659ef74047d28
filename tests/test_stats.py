"""Test statistics against published constants."""

import math

import pytest

from pyspark.sql import functions as F

from trailmark.functions.stats import erfc
from trailmark.operators import experiment


def arms(spark, nc, xc, nt, xt):
    return spark.createDataFrame(
        [(nc, xc, nt, xt)], "n_control long, x_control long, n_treatment long, x_treatment long"
    )


def test_two_proportion_z(spark):
    got = experiment.two_proportion_z(arms(spark, 1000, 50, 1000, 70)).first()
    assert got["z"] == pytest.approx(1.8831089, abs=1e-6)
    assert got["p_value"] == pytest.approx(0.0596856, abs=1e-6)
    assert got["significant"] == 0 and got["lift_pct"] == pytest.approx(40.0)
    wide = experiment.two_proportion_z(arms(spark, 100, 50, 1000, 70), pooled=False).first()
    half = 1.96 * math.sqrt(0.5 * 0.5 / 100 + 0.07 * 0.93 / 1000)
    assert wide["ci_high"] - wide["ci_low"] == pytest.approx(2 * half, abs=1e-5)


def test_erfc(spark):
    points = [0.0, 1e-9, 0.1, 0.7, 1.0, 2.0, 2.4999999, 2.5, 2.5000001, 4.0, 10.0, 26.0, 100.0, None]
    frame = spark.createDataFrame([(x,) for x in points], "x double").select("x", erfc(F.col("x")).alias("e"))
    for x, e in frame.collect():
        if x is None:
            assert e is None
        else:
            assert e == pytest.approx(math.erfc(x), rel=1e-11, abs=1e-300)


def test_cohens_h(spark):
    got = experiment.cohens_h(arms(spark, 1000, 50, 1000, 70)).first()["cohens_h"]
    assert got == pytest.approx(0.0844998, abs=1e-6)


@pytest.mark.parametrize(
    "nc,nt,chi2,p,balanced", [(5000, 5000, 0.0, 1.0, 1), (5050, 4950, 1.0, 0.3173105, 1), (6000, 4000, 400.0, 5.5e-89, 0)]
)
def test_srm(spark, nc, nt, chi2, p, balanced):
    got = experiment.srm_check(arms(spark, nc, 0, nt, 0)).first()
    assert got["chi2"] == pytest.approx(chi2)
    assert got["p_value"] == pytest.approx(p, rel=1e-2)
    assert got["balanced"] == balanced


def test_sample_size(spark):
    got = experiment.required_sample_size(arms(spark, 1000, 50, 1000, 70)).first()
    assert got["required_per_arm"] == pytest.approx(2209.4596, abs=1e-3)
    assert got["sufficient"] == 0
    equal = experiment.required_sample_size(arms(spark, 1000, 50, 1000, 50)).first()
    assert equal["required_per_arm"] is None and equal["sufficient"] == 0


def test_chi2_yates(spark):
    plain = experiment.chi2_contingency(arms(spark, 1000, 50, 1000, 70), yates=False).first()
    z = 1.8831089
    assert plain["chi2"] == pytest.approx(z * z, abs=1e-5)
    assert plain["p_value"] == pytest.approx(0.0596856, abs=1e-5)
    yates = experiment.chi2_contingency(arms(spark, 1000, 50, 1000, 70)).first()
    # (|ad - bc| - n/2)^2 n / (row and column totals)
    expected = (abs(50 * 930 - 70 * 950) - 1000) ** 2 * 2000 / (1000 * 1000 * 120 * 1880)
    assert yates["chi2"] == pytest.approx(expected, abs=1e-5)


def test_proportion_ci(spark):
    df = spark.createDataFrame([("a", 100, 20)], "group_label string, users long, buyers long")
    got = experiment.proportion_ci(df).first()
    half = 1.959964 * math.sqrt(0.2 * 0.8 / 100)
    assert got["ci_low"] == pytest.approx(0.2 - half, abs=1e-5)
    assert got["ci_high"] == pytest.approx(0.2 + half, abs=1e-5)


def test_adjusted_p_values(spark):
    """Against the definition, with ties and an absent p-value."""
    p = [0.01, 0.04, 0.03, 0.03, 0.5, 0.9, None]
    frame = spark.createDataFrame([(f"s{i}", v) for i, v in enumerate(p)], "slice string, p_value double")
    got = {r["slice"]: (r["p_adjusted"], r["discovery"]) for r in experiment.adjusted(frame, ["slice"], 0.06).collect()}
    known = sorted(v for v in p if v is not None)
    for i, v in enumerate(p[:-1]):
        want = min(1.0, min(w * 6 / (k + 1) for k, w in enumerate(known) if w >= v))
        assert got[f"s{i}"] == (pytest.approx(want, abs=1e-9), int(want <= 0.06))
    assert got["s6"] == (None, None)


def test_segment_arms_count_users_once_a_slice(spark):
    rows = [(1, "pv", "noon", 7), (1, "buy", "noon", 7), (1, "pv", "night", 8), (2, "buy", "night", 7), (3, "pv", "noon", 7)]
    behavior = spark.createDataFrame(rows, "user_id long, behavior_type string, time_period string, category_id long")
    segments = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "user_id long, user_segment string")
    by = {"segment": "user_segment", "period": "time_period", "category": "category_id"}
    arms = experiment.segment_arms(behavior, segments, by).collect()
    got = {(r["dimension"], r["slice"]): (r["n_control"], r["x_control"], r["n_treatment"], r["x_treatment"]) for r in arms}
    assert got == {
        ("all", "all"): (1, 1, 2, 1), ("segment", "a"): (1, 1, 1, 1), ("segment", None): (0, 0, 1, 0),
        ("period", "noon"): (0, 0, 2, 1), ("period", "night"): (1, 1, 1, 0),
        ("category", "7"): (1, 1, 2, 1), ("category", "8"): (0, 0, 1, 0),
    }
