import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions.special import f_tail, regularized_beta, t_tail
from meshlark.operators import stats

REGIONS = "frame int, region_id int, row double, col double, value double"


def test_tails(spark):
    df = spark.createDataFrame([(3.0, 2.0, 10.0), (1.5, 23.0, 300.0), (0.0, 3.0, 7.0)], "f double, a double, b double")
    got = [r["p"] for r in df.select(f_tail(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect()]
    assert got[0] == pytest.approx((1 + 2 * 3 / 10) ** -5, rel=1e-10) and got[2] == pytest.approx(1)
    t = spark.range(1).select(t_tail(F.lit(2.0), F.lit(1.0)).alias("a"), regularized_beta(F.lit(0.3), F.lit(2.0), F.lit(3.0)).alias("b")).first()
    assert t["a"] == pytest.approx(1 - 2 / math.pi * math.atan(2.0), rel=1e-10)
    assert t["b"] == pytest.approx(0.3483, abs=1e-12)


def test_false_discovery_rates(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.20), ("d", None)], "k string, p double")
    assert {r["k"]: r["q"] for r in stats.benjamini_hochberg(df, "p", "q").collect()} == {"a": 0.03, "b": 0.03, "c": pytest.approx(0.2), "d": None}
    two = df.withColumn("f", F.lit("x")).unionByName(df.withColumn("f", F.lit("y")))
    assert {r["q"] for r in stats.benjamini_hochberg(two, "p", "q", ["f"]).where("k = 'a'").collect()} == {0.03}


def wave(spark, n=50):
    return spark.createDataFrame([(1, i, 2.0 * i, 0.0, 2 + 0.5 * math.cos(2 * math.pi * (2 * i - 25) / 100)) for i in range(n)], REGIONS)


def test_harmonic(spark):
    r = stats.harmonic(wave(spark), 100).first()
    assert r["r_squared"] == pytest.approx(1) and r["peak_row"] == pytest.approx(25) and r["p_value"] == 0 and r["f_statistic"] is None
    flat = wave(spark).withColumn("value", F.lit(1.0))
    few = wave(spark, 3)
    assert stats.harmonic(flat, 100).first()["p_value"] is None and stats.harmonic(few, 100).first()["amplitude"] is None


def test_bins_and_variance(spark):
    rng = np.random.default_rng(0)
    rows = [(1, 15 * k + i, float(r), 0.0, m + rng.normal(0, 0.02)) for k, (r, m) in enumerate(((10, 0.2), (40, 0.5), (70, 0.8))) for i in range(15)]
    df = spark.createDataFrame(rows, REGIONS)
    assert stats.anova(df, 30).first()["anova_p_value"] < 0.05
    groups = [np.array([x[4] for x in rows if x[2] == r]) for r in (10, 40, 70)]
    grand = np.mean(np.concatenate(groups))
    f = (sum(15 * (g.mean() - grand) ** 2 for g in groups) / 2) / (sum(((g - g.mean()) ** 2).sum() for g in groups) / 42)
    assert stats.anova(df, 30).first()["anova_f_statistic"] == pytest.approx(f)
    assert [r["bin_count"] for r in stats.row_bins(df, 100, 30).orderBy("bin").collect()] == [15, 15, 15, 0]
    assert stats.pearson(df).first()["correlation"] == pytest.approx(np.corrcoef([x[2] for x in rows], [x[4] for x in rows])[0, 1])
    assert stats.pearson(df, periodic=True).first()["correlation"] is None
    assert stats.anova(df.withColumn("value", F.lit(1.0)), 30).first()["anova_p_value"] is None


def test_conclusions_say_no_more_than_tests(spark):
    df = spark.createDataFrame([(1, 0.01, None, None, None), (2, 0.2, 0.3, 0.01, 0.02)], "frame int, correlation_p_value double, correlation_q_value_bh double, anova_p_value double, anova_q_value_bh double")
    said = {r["frame"]: (r["pearson_conclusion"], r["anova_conclusion"]) for r in stats.conclusions(df).collect()}
    assert said[1] == ("Evidence of a linear association (p-value ≤ 0.05).", "ANOVA not performed (insufficient or constant groups).")
    assert said[2][0].startswith("Failed to reject") and "q-value ≤" in said[2][1]
    assert not any(w in x for v in said.values() for x in v for w in ("independent", "uniform"))


def test_complex_summaries(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, 1.0), (1, 0.0, 1.0, 9.0), (1, float("nan"), 0.0, 5.0), (1, 1.0, 1.0, 0.0)], "frame int, re double, im double, w double")
    a = stats.complex_summary(df.where("w <> 0"), 1).first()
    b = stats.complex_summary(df, 1, "w").first()
    assert (a["mean_real"], a["mean_imag"]) == (0.5, 0.5) and (b["mean_real"], b["mean_imag"]) == pytest.approx((0.1, 0.9))
    none = stats.complex_summary(df.where("re = 1").withColumn("re", F.lit(0.0)).withColumn("im", F.lit(0.0)), 6).first()
    assert none["orientation_degrees"] is None and none["phase_coherence"] is None


def test_bootstrap_repeats_itself(spark):
    rng = np.random.default_rng(4)
    rows = [(5, i, *(float(x) for x in rng.random(2) * 100), *(float(x) for x in rng.normal(0.5, 0.1, 2)), 1.0 + i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "frame int, region_id int, row double, col double, re double, im double, area double")
    a, b = ({r["metric"]: tuple(r) for r in stats.block_bootstrap(d, 100, 25, 300, seed=42).collect()} for d in (df, df.repartition(9)))
    assert a.keys() == b.keys() and all(a[k][2:5] == pytest.approx(b[k][2:5]) for k in a) and len(a) == 4
    mean = a["cell_mean_psi_magnitude"]
    assert mean[2] == pytest.approx(np.mean([math.hypot(r[4], r[5]) for r in rows])) and mean[3] < mean[2] < mean[4]
    zero = df.withColumns({"re": F.lit(0.0), "im": F.lit(0.0)})
    got = {r["metric"]: r["confidence_low"] for r in stats.block_bootstrap(zero, 100, 25, 50).collect()}
    assert got["phase_coherence_cell"] is None and got["harmonic_r_squared_raw"] is None and got["cell_mean_psi_magnitude"] == 0
    assert stats.block_bootstrap(df.where("false"), 100).count() == 0


def test_q_values_of_many_tests_need_no_task_with_all(spark):
    import random

    r = random.Random(2)
    p = lambda: r.choice([None, 0.0, 1.0, 0.5, r.random() ** 4, r.random(), float("nan"), 1.5])
    rows = [(i, r.choice(["a", "a", "b", None]), p()) for i in range(2000)]
    tests = spark.createDataFrame(rows, "test int, basis string, p double").repartition(7)
    for family in (None, ["basis"]):
        one, many = ({x.test: x.q for x in stats.benjamini_hochberg(tests, "p", "q", family, alone, 8).collect()} for alone in (10**6, 0))
        assert one.keys() == many.keys() and len(one) == 2000
        for k in one:
            assert many[k] == (None if one[k] is None else pytest.approx(one[k], rel=1e-12)), rows[k]
    few = spark.createDataFrame([(0, 0.01), (1, 0.02), (2, 0.20), (3, None)], "test int, p double")
    got = {x.test: x.q for x in stats.benjamini_hochberg(few, "p", "q", alone=0).collect()}
    assert got == {0: pytest.approx(0.03), 1: pytest.approx(0.03), 2: pytest.approx(0.20), 3: None}
    assert stats.benjamini_hochberg(few.where("p > 2"), "p", "q", alone=0).count() == 0
