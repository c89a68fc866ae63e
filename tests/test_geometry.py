"""Tessellations, order and structure on lattices and random points."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshlark.operators import geometry, joins, order, structure


def frame(spark, points, t=1):
    return spark.createDataFrame([(t, i, float(r), float(c)) for i, (r, c) in enumerate(points)], "frame int, region_id int, row double, col double")


def hexagonal(rows, cols, s=10.0):
    return [(i * s * math.sqrt(3) / 2, 5 + j * s + s / 2 * (i % 2)) for i in range(rows) for j in range(cols)]


def by_id(df, *columns):
    return {r["region_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(3, 40))
def test_circles_are_empty(seed, n):
    xy = np.random.default_rng(seed).random((n, 2))
    t = geometry.delaunay(xy)
    for i, j, k in t:
        a, b, c = xy[[i, j, k]]
        m = np.linalg.solve(2 * np.array([b - a, c - a]), [b @ b - a @ a, c @ c - a @ a])
        r = np.hypot(*(a - m))
        others = np.delete(xy, [i, j, k], axis=0)
        assert (np.hypot(*(others - m).T) > r * (1 - 1e-9)).all()
    hull = len({p for p in range(n)} & set(t.ravel()))
    assert hull == n  # every point is a corner


def test_lattice_has_order_and_turns(spark):
    points = [(i * math.sqrt(3) / 2, j + 0.5 * (i % 2)) for i in range(7) for j in range(7)]
    rng = np.random.default_rng(0)
    points = np.array(points) + rng.normal(0, 1e-4, (49, 2))
    c, s = math.cos(0.1), math.sin(0.1)
    turned = points @ np.array([[c, -s], [s, c]])  # (row, col): theta grows by 0.1
    values = []
    for p in (points, turned):
        df = frame(spark, p)
        values.append(complex(*by_id(order.psi(df, geometry.triangulate(df)), "re", "im")[24]))
    assert abs(values[0]) > 0.95
    assert abs(values[1] / values[0]) == pytest.approx(1, abs=1e-3)
    assert abs(np.angle(values[1] / values[0])) == pytest.approx(0.6, abs=1e-3)


@pytest.mark.parametrize("n", range(1, 4))
def test_few_points_have_no_order(spark, n):
    df = frame(spark, [(0, 0), (0, 5), (4, 2)][:n])
    t = geometry.triangulate(df)
    assert {r["psi_mag"] for r in order.psi(df, t).collect()} == {0.0}
    assert {r["boundary"] for r in geometry.boundary(df, t, 10, 10, False).collect()} == {True}


def test_repeated_points_have_no_order(spark):
    df = frame(spark, [(0, 0), (0, 0), (5, 5), (5, 0), (0, 5)])
    assert geometry.triangulate(df).count() == 0


def test_wrapped_lattice_is_perfect(spark):
    rows, s = 10, 10.0
    height = rows * s * math.sqrt(3) / 2
    points = np.array(hexagonal(rows, 10, s))
    points += np.random.default_rng(1).normal(0, 1e-3, points.shape)
    df = frame(spark, np.column_stack([points[:, 0] % height, points[:, 1]]))
    t = geometry.triangulate(df, height).persist()
    flags = geometry.boundary(df, t, height, 110, True)
    edge = {r["region_id"] for r in flags.where("boundary").collect()}
    assert all(i % 10 in (0, 9) for i in edge) and len(edge) >= 10  # lateral cells only
    found = structure.structure_of(df, t, flags).first()
    assert found["mean_coordination"] == 6 and found["defect_fraction"] == 0 and found["dislocation_fraction"] is None
    shifted = df.withColumn("row", F.pmod(F.col("row") + 33.3, F.lit(height)))
    again = by_id(order.psi(shifted, geometry.triangulate(shifted, height)), "psi_mag")
    for i, (m,) in by_id(order.psi(df, t), "psi_mag").items():
        assert again[i][0] == pytest.approx(m, abs=1e-6)


def test_hand_made_graph(spark):
    # 5-7 pair inside six-fold neighbours; region 8 is the boundary
    z = spark.createDataFrame([(1, i, n, True) for i, n in enumerate([5, 7, 6, 6, 6, 6, 6])] + [(1, 7, 6, False), (1, 8, 3, False)], "frame int, region_id int, z int, interior boolean")
    edges = spark.createDataFrame([(1, a, b) for a, b in [(0, 1), (1, 0), (0, 2), (2, 0)]], "frame int, src int, dst int")
    r = structure.defects(z, edges).first()
    assert r["interior_regions"] == 7 and r["fraction_z5"] == pytest.approx(1 / 7) and r["defect_fraction"] == pytest.approx(2 / 7)
    assert r["dislocation_fraction"] == 1.0 and r["net_charge_per_region"] == 0


def test_smoothing(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.0, 2.0, 0.5), (1, 2, 0.0, 5.0, 1.0)], "frame int, region_id int, row double, col double, psi_mag double")
    assert by_id(order.smooth(line, 1), "smoothed") == {0: (0.5,), 1: (0.0,), 2: (0.5,)}
    assert by_id(order.smooth(line, 0), "smoothed") == {0: (0.0,), 1: (0.5,), 2: (1.0,)}
    assert by_id(order.smooth(line, 9, include_self=True), "smoothed") == {i: (0.5,) for i in range(3)}
    gap = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0), (1, 1, 0.0, 1.0, None), (1, 2, 0.0, 2.0, 0.5), (1, 3, 0.0, 9.0, 0.0)], line.schema)
    assert by_id(order.smooth(gap, 1), "smoothed") == {0: (0.5,), 1: (None,), 2: (1.0,), 3: (0.5,)}


@pytest.mark.parametrize("height", [None, 50.0])
def test_nearest_neighbours_against_all_pairs(spark, height):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.random((60, 2)) * [50, 80], rng.random((20, 2)), [[49.0, 4000.0]]])  # a cluster, and one far away
    got = {(r["i"], r["rank"]): r["j"] for r in joins.knn_self_join(frame(spark, points), 4, height).collect()}
    for i, p in enumerate(points):
        gap = np.abs(points - p)
        if height:
            gap[:, 0] = np.minimum(gap[:, 0], height - gap[:, 0])
        d = (gap**2).sum(axis=1)
        d[i] = np.inf
        assert [got[i, k] for k in range(1, 5)] == list(np.lexsort((np.arange(len(d)), d))[:4])


@pytest.mark.parametrize("height", [None, 30.0])
def test_range_join_against_all_pairs(spark, height):
    points = np.random.default_rng(6).random((80, 2)) * 30
    got = {(r["i"], r["j"]) for r in joins.range_self_join(frame(spark, points), 7.0, height).collect()}
    want = set()
    for i in range(80):
        for j in range(i + 1, 80):
            gap = np.abs(points[i] - points[j])
            if height:
                gap[0] = min(gap[0], height - gap[0])
            if np.hypot(*gap) <= 7:
                want.add((i, j))
    assert got == want
    seam = frame(spark, [(1, 50), (99, 50)])
    assert joins.range_self_join(seam, 10.0, 100.0).count() == 1 and joins.range_self_join(seam, 10.0).count() == 0


def test_decay(spark):
    rs = [1.25 + 2.5 * i for i in range(60)]
    curve = spark.createDataFrame([(1, i, r, math.exp(-r / 30), 10.0) for i, r in enumerate(rs)], "frame int, bin int, r double, g6_normalized double, spacing double")
    got = structure.decay_lengths(curve, 0.01).first()
    assert got["xi_1e_pixels"] == pytest.approx(30, rel=0.05) and got["exp_xi_pixels"] == pytest.approx(30)
    assert got["exp_r_squared"] == pytest.approx(1) and got["exp_r_squared"] > got["power_r_squared"]
    fast = spark.createDataFrame([(1, i, r, math.exp(-r / 3), 10.0) for i, r in enumerate(1.25 + 2.5 * k for k in range(20))], curve.schema)
    got = structure.decay_lengths(fast).first()
    assert got["xi_1e_is_upper_bound"] and got["xi_1e_pixels"] == 8.75


def test_missing_points_show(spark):
    full = np.array([(i * 20 * math.sqrt(3) / 2, j * 20 + 10 * (i % 2)) for i in range(30) for j in range(30)])
    full += np.random.default_rng(2).normal(0, 1, full.shape)
    kept = full[np.random.default_rng(3).random(len(full)) > 0.2]
    h, w = 30 * 20 * math.sqrt(3) / 2, 610.0
    a, b = (structure.spacing_qc(df, geometry.triangulate(df), h, w).first() for df in (frame(spark, full), frame(spark, kept)))
    assert b["median_nn_distance_pixels"] == pytest.approx(a["median_nn_distance_pixels"], rel=0.05)
    assert a["nn_distance_ratio"] - b["nn_distance_ratio"] > 0.08 and a["hole_area_fraction"] < 0.02 < 0.3 < b["hole_area_fraction"]


def test_correlation_of_constant_order(spark):
    points = np.random.default_rng(8).random((60, 2)) * 100
    df = frame(spark, points).withColumns({"re": F.lit(0.6), "im": F.lit(0.8)})
    curve = structure.g6_curve(df, 100, 100, True).collect()
    assert all(r["g6_normalized"] == pytest.approx(1) for r in curve if r["pairs"]) and sum(r["pairs"] for r in curve) > 500


def test_triangles_of_many_and_of_lattice_points():
    rng = np.random.default_rng(9)
    points = rng.random((3000, 2)) * 1000
    made = geometry.delaunay(points)
    assert len(made) < 2 * 3000 and len(set(made.ravel().tolist())) == 3000
    for t in made[rng.integers(0, len(made), 200)]:
        a, b, c = points[t]
        d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        m = a + np.array([(c[1] - a[1]) * ((b - a) ** 2).sum() - (b[1] - a[1]) * ((c - a) ** 2).sum(), (b[0] - a[0]) * ((c - a) ** 2).sum() - (c[0] - a[0]) * ((b - a) ** 2).sum()]) / d
        assert (((points - m) ** 2).sum(axis=1) < ((a - m) ** 2).sum() * (1 - 1e-9)).sum() == 0
    grid = np.array([(i, j) for i in range(15) for j in range(15)], float)
    corners = grid[geometry.delaunay(grid)]
    twice = (corners[:, 1, 0] - corners[:, 0, 0]) * (corners[:, 2, 1] - corners[:, 0, 1]) - (corners[:, 1, 1] - corners[:, 0, 1]) * (corners[:, 2, 0] - corners[:, 0, 0])
    assert np.abs(twice).sum() / 2 == 14 * 14


def corners(df, tile, height=None):
    rows = geometry.triangulate(df, height, tile=tile).collect()
    return sorted(sorted(((r[f"id{m}"], r[f"image{m}"]) for m in range(3))) for r in rows)


@pytest.mark.parametrize("kind", ["even", "lattice", "crowded", "curve", "wrapped"])
def test_tiles_give_the_triangles_of_one_task(spark, kind):
    rng = np.random.default_rng(3)
    points = {
        "even": rng.random((900, 2)) * 1000,
        # every square has four corners on one circle
        "lattice": np.array([(i, j) for i in range(24) for j in range(24)], float),
        "crowded": np.vstack([rng.normal(0, 0.001, (400, 2)), rng.random((200, 2)) * 100]),
        "curve": np.stack([np.cos(np.arange(200)), np.sin(np.arange(200))], axis=1),
        "wrapped": rng.random((300, 2)) * 1000,
    }[kind]
    df = spark.createDataFrame([(1, (1 << 60) + i, float(r), float(c)) for i, (r, c) in enumerate(points)], "frame int, region_id long, row double, col double").union(frame(spark, [(0, 0), (0, 5), (4, 2)], 2).selectExpr("frame", "CAST(region_id AS long)", "row", "col"))
    height = 1000.0 if kind == "wrapped" else None
    got = corners(df, 60, height)
    assert got == corners(df, 10**9, height)
    assert len(got) > 150


def test_few_points_of_a_tile_go_on():
    xy = np.random.default_rng(5).random((4000, 2))
    final, outline, open_ = geometry._merge(xy, set(), (0.0, 1.0, 0.0, 1.0))
    assert open_.sum() < 700 and len(final) > 7000
    assert {x for e in outline for x in e} <= set(np.flatnonzero(open_).tolist())


def test_a_set_has_one_triangulation_whatever_the_order():
    grid = np.array([(i, j) for i in range(9) for j in range(9)], float)
    made = set()
    for seed in range(4):
        order_ = np.random.default_rng(seed).permutation(len(grid))
        made.add(frozenset(frozenset(order_[list(t)].tolist()) for t in geometry.delaunay(grid[order_]).tolist()))
    assert len(made) == 1


def test_nearest_of_crowded_and_far_points(spark, monkeypatch):
    """A crowd and points far from it and from each other: the right neighbours, and no point meets its whole frame."""
    import random

    from meshlark.operators import joins

    r, wholes = random.Random(4), []
    at = [(r.gauss(0, 1), r.gauss(0, 1)) for _ in range(500)] + [(r.uniform(-900, 900), r.uniform(-900, 900)) for _ in range(40)]
    points = spark.createDataFrame([(1, i, *p) for i, p in enumerate(at)] + [(2, 0, 0.0, 0.0)], "frame int, region_id int, row double, col double")
    got = {}
    kind = type(points)
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None: (wholes.append(on) if on == "frame" and "i" in self.columns else None) or join(self, other, on, how))
    for x in joins.knn_self_join(points, 6).collect():
        got.setdefault((x["frame"], x["i"]), []).append((x["rank"], x["j"]))
    near = lambda i: sorted((x for x in range(len(at)) if x != i), key=lambda x: ((at[i][0] - at[x][0]) ** 2 + (at[i][1] - at[x][1]) ** 2, x))[:6]
    assert {k: [j for _, j in sorted(x)] for k, x in got.items()} == {(1, i): near(i) for i in range(len(at))}
    assert not wholes
