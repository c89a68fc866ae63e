"""Scattered interpolation: triangles that hold points, linear values over holes, slopes that bend least, smooth patches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.operators import interpolate, piv


def field(spark, xy, of, number=1):
    rows = [(number, float(x), float(y), *map(float, of(x, y))) for x, y in xy]
    return spark.createDataFrame(rows, "field int, x double, y double, u double, v double")


def points(spark, xy, number=1):
    return spark.createDataFrame([(number, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "field int, point int, x double, y double")


def found(df):
    return {r.point: (r.u, r.v) for r in df.collect()}


@pytest.fixture(scope="module")
def places():
    rng = np.random.default_rng(11)
    inner = rng.random((40, 2)) * 8 + 1
    crowd = rng.normal(5, 0.01, (15, 2))  # triangles of very different sizes
    return np.vstack([inner, crowd, [(0, 0), (10, 0), (0, 10), (10, 10)]])


def plane(x, y):
    return 2 * x - 3 * y + 1, 0.5 * x + y


@pytest.mark.parametrize("method", ["bilinear", "bicubic"])
def test_planes_are_exact_and_outside_is_zero(spark, places, method):
    rng = np.random.default_rng(2)
    at = [*(rng.random((60, 2)) * 10).tolist(), (5.0, 5.0), *places[:10].tolist(), (0.0, 0.0), (10.0, 5.0), (-0.1, 5.0), (11.0, 11.0)]
    got = found(piv.METHODS[method](points(spark, at), field(spark, places, plane)))
    for i, (x, y) in enumerate(at[:-2]):
        assert got[i] == pytest.approx(plane(x, y), abs=1e-7)
    assert got[len(at) - 2] == got[len(at) - 1] == (0.0, 0.0)


def test_holes_are_bridged_and_missing_numbers_are_holes(spark):
    grid = [(x, y) for x in range(5) for y in range(5) if (x, y) != (2, 2)]
    given = field(spark, grid, plane).union(spark.createDataFrame([(1, 2.0, 2.0, None, 1.0), (1, float("nan"), 2.0, 1.0, 1.0)], "field int, x double, y double, u double, v double"))
    at = [(2.0, 2.0), (2.3, 1.9), (1.5, 2.5)]
    got = found(piv.METHODS["bilinear"](points(spark, at), given))
    for i, (x, y) in enumerate(at):
        assert got[i] == pytest.approx(plane(x, y), abs=1e-9)


def test_grid_cells_are_cut_from_lower_left_to_upper_right(spark):
    corners = {(0, 0): 0.0, (1, 0): 0.0, (0, 1): 0.0, (1, 1): 1.0}
    got = found(piv.METHODS["bilinear"](points(spark, [(0.75, 0.25), (0.25, 0.75), (0.5, 0.5)]), field(spark, corners, lambda x, y: (corners[x, y], 0))))
    assert [got[i][0] for i in range(3)] == pytest.approx([0.25, 0.25, 0.5])


def test_few_or_repeated_samples(spark):
    at = points(spark, [(0.2, 0.2)])
    two = field(spark, [(0, 0), (1, 1)], plane)
    line = field(spark, [(i, i) for i in range(5)], plane)
    twice = field(spark, [(0, 0), (1, 0), (0, 1), (0, 0)], plane)
    assert found(piv.METHODS["bilinear"](at, two)) == found(piv.METHODS["bicubic"](at, line)) == {0: (0.0, 0.0)}
    assert found(piv.METHODS["bilinear"](at, twice))[0] == pytest.approx(plane(0.2, 0.2), abs=1e-9)
    assert piv.METHODS["bilinear"](at.where("false"), two).count() == 0


def brute_slopes(xy, edges, f):
    """The least bending by one linear system."""
    n = len(xy)
    a, b = np.zeros((2 * n, 2 * n)), np.zeros(2 * n)
    for i, j in edges:
        e = xy[j] - xy[i]
        m = np.outer(e, e) / np.hypot(*e) ** 3
        a[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] += 2 * m
        a[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] += m
        b[2 * i : 2 * i + 2] += 3 * (f[j] - f[i]) * e / np.hypot(*e) ** 3
    return np.linalg.solve(a, b).reshape(n, 2)


def test_slopes_solve_the_system(spark, places):
    wave = lambda x, y: (np.sin(x), np.cos(y) * x)
    samples = interpolate.samples_of(field(spark, places, wave))
    edges = interpolate.edges_of(interpolate.mesh(samples))
    at = {(float(x), float(y)): i for i, (x, y) in enumerate(places)}
    pairs = [(at[r.x, r.y], at[r.ox, r.oy]) for r in edges.collect()]
    got = interpolate.slopes(samples, edges).collect()
    for k, (c, value) in enumerate(zip("uv", zip(*(wave(x, y) for x, y in places)))):
        want = brute_slopes(places, pairs, value)
        for r in got:
            assert (r[f"{c}_x"], r[f"{c}_y"]) == pytest.approx(tuple(want[at[r.x, r.y]]), abs=2e-6 * np.abs(want).max())
    assert len(got) == len(places) and k == 1


def test_patches_are_smooth_and_keep_quadratics(spark, places, monkeypatch):
    curve = lambda x, y: (x * x - 2 * x * y + 0.5 * y * y + x, 3 * x * y)

    def exact(samples, edges, rounds):
        x, y = F.col("x"), F.col("y")
        return samples.select("field", "x", "y", (2 * x - 2 * y + 1).alias("u_x"), (y - 2 * x).alias("u_y"), (3 * y).alias("v_x"), (3 * x).alias("v_y"))

    at = (np.random.default_rng(5).random((80, 2)) * 9.8 + 0.1).tolist()
    given = field(spark, places, curve)
    with monkeypatch.context() as m:
        m.setattr(interpolate, "slopes", exact)
        got = found(interpolate.cubic(points(spark, at), given))
    for i, (x, y) in enumerate(at):
        assert got[i] == pytest.approx(curve(x, y), abs=1e-8)

    # along a line values and their slopes change without steps: with finer steps the changes shrink
    bumpy = field(spark, places, lambda x, y: (np.sin(2 * x) * y, 0))
    steps = (0.004, 0.001)
    lines = [np.array([(1 + 7 * t, 2 + 5 * t) for t in np.arange(0, 0.4, h)]) for h in steps]
    made = found(interpolate.cubic(points(spark, np.vstack(lines)), bumpy))
    values = [np.array([made[i][0] for i in range(len(lines[0]))]), np.array([made[len(lines[0]) + i][0] for i in range(len(lines[1]))])]
    bends = [np.abs(np.diff(v, 2)).max() / h for v, h in zip(values, steps)]
    assert bends[1] < 0.5 * bends[0]


def test_points_meet_few_triangles(spark):
    r = random.Random(1)
    long = [(0, 0), (1000, 1), *[(500 + r.random(), 0.5 + r.random() / 1000) for _ in range(60)], (0, 900)]
    samples = interpolate.samples_of(field(spark, long, plane))
    mesh = interpolate.mesh(samples)
    at = points(spark, [(500 + r.random(), 0.5 + r.random() / 1000) for _ in range(40)])
    held = interpolate.locate(at, mesh).collect()
    assert len({x.point for x in held}) == len(held) >= 38
    assert all(min(x.b0, x.b1, x.b2) >= -interpolate.EDGE for x in held)
