"""Exact quantiles by selection, against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.operators import label, piv, stats
from meshlark.operators.quantiles import grouped_quantiles


@pytest.fixture(scope="module")
def values():
    r = random.Random(4)
    groups = {
        "even": [r.random() for _ in range(900)],
        "tails": [r.choice([-1, 1]) * 10 ** r.uniform(-200, 200) for _ in range(700)],
        "ties": [r.choice([0.0, 1.0]) for _ in range(501)],
        "mostly": [5.0] * 600 + [r.random() for _ in range(37)],
        "one": [3.0],
        "none": [None],
        None: [float(i) for i in range(333)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    r.shuffle(rows)
    return groups, rows


PROBS = {"q0": 0.0, "q02": 0.02, "q5": 0.5, "q98": 0.98, "q1": 1.0}


@pytest.mark.parametrize("bound", [1, 20, 10**6])
def test_quantiles_equal_sorting(spark, values, bound):
    groups, rows = values
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    v = F.col("v")
    got = {r.g: r for r in grouped_quantiles(df, ["g"], {k: (v, p) for k, p in PROBS.items()}, [F.count("*").alias("n")], bound).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        known = [x for x in vs if x is not None]
        assert got[g].n == len(vs)
        for k, p in PROBS.items():
            want = float(np.quantile(known, p)) if known else None
            assert got[g][k] == (None if want is None else pytest.approx(want, rel=1e-12))


def test_medians_of_large_and_small_groups_agree(spark):
    r = random.Random(8)
    areas = spark.createDataFrame([(f, r.randint(1, 60), r.random() < 0.5) for f in (1, 1, 1, 2) for _ in range(300)], "frame int, area long, kept boolean")
    assert sorted(stats.area_summary(areas, bound=7).collect()) == sorted(stats.area_summary(areas).collect())
    filtered = areas.selectExpr("*", "false AS rejected_min", "false AS rejected_max", "NOT kept AS rejected_border")
    assert sorted(label.quality(filtered, bound=7).collect()) == sorted(label.quality(filtered).collect())
    field = spark.createDataFrame([(1, r.random(), r.random()) for _ in range(500)], "field int, u double, v double")
    small, large = piv.speed_range(field).first(), piv.speed_range(field, bound=9).first()
    assert (small.low, small.high) == (pytest.approx(large.low, rel=1e-12), pytest.approx(large.high, rel=1e-12))


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert grouped_quantiles(none, ["g"], {"m": (F.col("v"), 0.5)}).count() == 0
    assert [r.m for r in grouped_quantiles(none, [], {"m": (F.col("v"), 0.5)}).collect()] == [None]
