"""Labels, spectra and velocity fields."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshlark.operators import fourier, label, piv


def pixels(spark, mask):
    return spark.createDataFrame([(1, int(r), int(c)) for r, c in zip(*np.nonzero(mask))], "frame int, row int, col int")


def found(spark, mask, periodic=False):
    mask = np.asarray(mask)
    runs = label.components(pixels(spark, mask), mask.shape[0] if periodic else None)
    return sorted((r["label"], r["area"], r["row"], r["col"]) for r in label.regions(runs, *mask.shape, periodic).collect())


def test_diagonals_touch(spark):
    assert found(spark, np.eye(2)) == [(1, 2, 0.5, 0.5)]


def test_components_across_the_seam(spark):
    mask = np.zeros((100, 60))
    mask[:5, 20:30] = mask[95:, 20:30] = mask[50:55, 5:10] = 1
    assert found(spark, mask, True) == [(1, 100, 99.5, 24.5), (2, 25, 52.0, 7.0)]
    assert len(found(spark, mask)) == 3
    corner = np.zeros((10, 10))
    corner[0, 4] = corner[9, 5] = 1
    assert len(found(spark, corner, True)) == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_runs_against_flooding(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((6, 7)) < 0.45
    runs = [(r, c0, c1) for r in range(6) for c0, c1 in _runs(mask[r])]
    if not runs:
        return
    row, first, last = (np.array(x) for x in zip(*runs))
    labels = np.unique(label._join_runs(row, first, last), return_inverse=True)[1] + 1
    flood, n = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask)):
        if not flood[r, c]:
            n += 1
            stack = [(r, c)]
            while stack:
                y, x = stack.pop()
                if 0 <= y < 6 and 0 <= x < 7 and mask[y, x] and not flood[y, x]:
                    flood[y, x] = n
                    stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert [flood[r, c] for r, c, _ in runs] == labels.tolist()


def _runs(line):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(int), [0]])))
    return [(a, b - 1) for a, b in zip(edge[::2], edge[1::2])]


def test_filters(spark):
    mask = np.zeros((8, 12))
    mask[0, 0] = 1
    mask[2:4, 3:5] = mask[4:7, 7:10] = 1
    regions = label.regions(label.components(pixels(spark, mask)), 8, 12, False)
    kept = label.filter_regions(regions, 4, 9)
    assert sorted((r["area"], r["new_label"]) for r in kept.where("kept").collect()) == [(4, 1), (9, 2)]
    q = label.quality(label.filter_regions(regions, 4, 8, True)).first()
    assert (q["raw_component_count"], q["retained_component_count"], q["rejected_min_area_count"], q["rejected_max_area_count"], q["rejected_border_count"]) == (3, 1, 1, 1, 1)
    edge = np.zeros((8, 8))
    edge[0, 3] = edge[4, 0] = 1
    wrapped = label.regions(label.components(pixels(spark, edge), 8), 8, 8, True)
    assert [r["col"] for r in label.filter_regions(wrapped, exclude_border=True).where("rejected_border").collect()] == [0.0]


def grid(spark, image):
    return spark.createDataFrame([(1, r, c, float(v)) for (r, c), v in np.ndenumerate(image)], "frame int, row int, col int, value double")


@pytest.mark.parametrize("shape", [(8, 8), (8, 9), (9, 8), (9, 9)])
def test_spectrum_and_annuli(spark, shape):
    image = np.random.default_rng(1).random(shape)
    spec = fourier.spectrum(grid(spark, image), *shape)
    want = np.fft.fftshift(np.fft.fft2(image))
    for r in spec.collect():
        assert complex(r["re"], r["im"]) == pytest.approx(want[r["fr"] + shape[0] // 2, r["fc"] + shape[1] // 2], abs=1e-9)
    band = fourier.band_spectrum(grid(spark, image), *shape, (0.01, 0.7), "none")
    assert fourier.radial_profile(band, *shape).agg(F.sum("n")).first()[0] == shape[0] * shape[1] - 1


def test_sinusoids(spark):
    x = np.arange(64)
    image = np.tile(np.sin(2 * np.pi * 5 * x / 64), (64, 1))
    assert {(r["fr"], r["fc"]) for r in fourier.top_bins(fourier.spectrum(grid(spark, image), 64, 64), 2).collect()} == {(0, -5), (0, 5)}
    image = np.tile(np.cos(2 * np.pi * 8 * np.arange(80) / 80), (48, 1))
    top = fourier.peak_pairs(fourier.band_spectrum(grid(spark, image), 48, 80, (0.08, 0.12), "none"), 48, 80, 5).where("rank = 1").first()
    assert top["wavelength"] == pytest.approx(10) and top["member_count"] == 2
    alternating = np.indices((8, 8)).sum(axis=0) % 2 * 2.0 - 1
    line = np.tile((-1.0) ** np.arange(8), (8, 1))
    top = fourier.peak_pairs(fourier.band_spectrum(grid(spark, line), 8, 8, (0.4, 0.6), "none"), 8, 8, 1).first()
    assert top["member_count"] == 1 and top["wavelength"] == 2 and alternating.sum() == 0


def test_constant_images_have_no_bins_of_note(spark):
    spec = fourier.spectrum(grid(spark, np.ones((8, 8))), 8, 8)
    bins = fourier.top_bins(spec, 63)
    assert bins.count() == 63 and bins.where("fr = 0 AND fc = 0").count() == 0
    assert fourier.legacy_metric(fourier.spectrum(grid(spark, np.zeros((8, 8))), 8, 8)).first()["metric"] == 0
    assert fourier.reconstruct(bins, 8, 8).agg(F.max("value")).first()[0] <= 1


def test_rectangles(spark):
    g = grid(spark, np.arange(20).reshape(4, 5))
    assert fourier.center_crop(g, 2, 4, 5).orderBy("row", "col").select("value").toPandas()["value"].tolist() == [6, 7, 11, 12]
    assert fourier.roll_rows(g, 1, 4).where("row = 0 AND col = 0").first()["value"] == 15
    with pytest.raises(ValueError):
        fourier.crop(g, (3, 2, 0, 1))


def field(spark, f, fields=(0, 1)):
    return spark.createDataFrame([(t, float(x), float(y), *map(float, f(x, y))) for t in fields for x in range(0, 21, 5) for y in range(0, 21, 5)], "field int, x double, y double, u double, v double")


def test_interpolation(spark):
    f = field(spark, lambda x, y: (1 + 2 * x - y, 0.5 * y), (0,))
    points = spark.createDataFrame([(0, 0, 7.0, 3.0), (0, 1, 10.0, 15.0), (0, 2, 99.0, 0.0)], "field int, point int, x double, y double")
    linear = {r["point"]: (r["u"], r["v"]) for r in piv.linear(points, f).collect()}
    assert linear[0] == pytest.approx((12, 1.5)) and linear[1] == pytest.approx((6, 7.5)) and linear[2] == (0, 0)
    near = {r["point"]: (r["u"], r["v"]) for r in piv.nearest(points, f).collect()}
    assert near[0] == (6, 2.5) and near[2] == (41, 0)
    weighted = {r["point"]: (r["u"], r["v"]) for r in piv.inverse_distance(points, f).collect()}
    assert weighted[1] == (6, 7.5)


def test_polygons_move(spark):
    f = field(spark, lambda x, y: (1.5, 2.0))
    path = {(r["step"], r["vertex"]): (r["x"], r["y"]) for r in piv.evolve_polygon(spark, [(2, 3), (8, 3), (8, 18)], f, 19, 21, periodic=True).collect()}
    assert path[1, 0] == (3.5, 5.0) and path[2, 0] == (5.0, 7.0) and path[1, 2] == (9.5, 1.0)


@pytest.mark.parametrize("method", ["nearest", "inverse_distance", "bilinear"])
def test_one_query_moves_polygons_as_steps_do(spark, method):
    f = field(spark, lambda x, y: (1.5 + x / 9 - y / 40, 2.0 - x / 7), (0, 1, 2))
    start = [(2.1, 3.3), (8.4, 3.2), (8.7, 18.0), (19.9, 0.1)]
    whole = {(r.step, r.vertex): (r.x, r.y) for r in piv.evolve_polygon(spark, start, f, 19, 21, method=method).collect()}
    here = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(start)], "vertex int, x double, y double")
    steps = {(r.step, r.vertex): (r.x, r.y) for r in piv._evolve_by_steps(here, f, 19, 21, False, method).collect()}
    assert whole.keys() == steps.keys() and len(whole) == 16
    for k in steps:
        assert whole[k] == pytest.approx(steps[k], abs=1e-9)


def test_regions_of_interest(spark):
    image = np.full((12, 20), np.nan)
    image[2:6, 8:18] = 0.75
    values = spark.createDataFrame([(1, int(r), int(c), 0.75) for r, c in zip(*np.nonzero(~np.isnan(image)))], "frame int, row int, col int, value double")
    r = piv.roi_statistics(values, [(9.5, 1.5), (16.5, 1.5), (16.5, 5.5), (9.5, 5.5)], 12, 20).first()
    assert r["average"] == 0.75 and r["geometric_pixels"] == 28 and r["valid_pixels"] == 28
    assert math.isclose(piv.speed_range(field(spark, lambda x, y: (3, 4))).first()["high"], 6)


def test_polygons(spark):
    from meshlark.operators import polygons

    g = grid(spark, np.arange(42).reshape(6, 7))
    shape = [(1.5, 0.5), (4.5, 0.5), (4.5, 3.5)]  # below the diagonal: pixels (1, 2), (1, 3), (1, 4), (2, 3), ...
    got = {(r["row"], r["col"]): r["value"] for r in polygons.crop_to_polygon(g, shape).collect()}
    assert got[0, 0] == 9 and got[0, 2] == 11 and got[2, 0] == 0 and got[2, 2] == 25 and len(got) == 9
    near = spark.createDataFrame([(1, 1.5, 3.4), (1, 2.4, 3.0), (1, 0.4, 0.0)], "frame int, row double, col double")
    assert [(r["row"], r["col"]) for r in polygons.centroid_impulses(near, shape, 6, 7).collect()] == [(2, 3)]
    assert polygons.pad_center(g, 6, 7, 8, 10).where("row = 1 AND col = 1").first()["value"] == 0
    moved = polygons.to_display(spark.createDataFrame([(0.0, 18.0)], "x double, y double"), 20, 5)
    assert moved.first()["y"] == 3 and polygons.from_display(moved, 20, 5).first()["y"] == 18
    with pytest.raises(ValueError):
        polygons.pad_center(g, 6, 7, 5, 9)


def test_region_series_is_each_frame_by_itself(spark):
    rng = np.random.default_rng(2)
    rows = [(t, r, c, float(rng.random())) for t in range(3) for r in range(20) for c in range(25) if rng.random() < 0.8]
    pixels = spark.createDataFrame(rows, "frame int, row int, col int, value double")
    shapes = {0: [(2.0, 3.0), (20.0, 4.0), (11.5, 17.2)], 1: [(0.0, 0.0), (24.0, 0.0), (24.0, 19.0), (0.0, 19.0)], 2: [(-3.0, 5.0), (30.0, 6.0), (12.0, 30.0), (9.0, 9.0)]}
    polygons = spark.createDataFrame([(t, v) for t, v in shapes.items()], "frame int, polygon array<struct<x:double,y:double>>")
    got = {r["frame"]: tuple(r)[1:] for r in piv.roi_series(pixels, polygons, 20, 25).collect()}
    for t, shape in shapes.items():
        one = tuple(piv.roi_statistics(pixels.where(f"frame = {t}"), shape, 20, 25).first())[1:]
        assert got[t][1:] == one[1:] and got[t][0] == pytest.approx(one[0])


def test_nearest_samples_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    field = [(f, float(x), float(y), float(i), 0.0) for f in range(2) for i, (x, y) in enumerate(rng.random((150, 2)) * 50)]
    points = [(f, i, float(x), float(y)) for f in range(2) for i, (x, y) in enumerate(np.vstack([rng.random((80, 2)) * 50, [[-400.0, 7.0], [999.0, 999.0]]]))]
    got = {(r["field"], r["point"]): r["u"] for r in piv.nearest(spark.createDataFrame(points, "field int, point int, x double, y double"), spark.createDataFrame(field, "field int, x double, y double, u double, v double")).collect()}
    for f, i, x, y in points:
        assert got[f, i] == min((s for s in field if s[0] == f), key=lambda s: (s[1] - x) ** 2 + (s[2] - y) ** 2)[3]


def brute_labels(mask, wrap):
    """Labels by flooding pixel after pixel, in row order, and those that the seam joins."""
    h, w = mask.shape
    out, wrapped, n = np.zeros((h, w), int), set(), 0
    for r, c in zip(*np.nonzero(mask)):
        if out[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        out[r, c] = n
        while todo:
            y, x = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    yy, xx = y + dy, x + dx
                    seam = wrap and not 0 <= yy < h
                    yy = yy % h if wrap else yy
                    if 0 <= yy < h and 0 <= xx < w and mask[yy, xx]:
                        if seam:
                            wrapped.add(n)
                        if not out[yy, xx]:
                            out[yy, xx] = n
                            todo.append((yy, xx))
    return out, wrapped


@pytest.mark.parametrize("wrap", [False, True])
@pytest.mark.parametrize("band, alone", [(2, 0), (5, 1000), (256, 1000)])
def test_bands_are_joined_to_components(spark, wrap, band, alone):
    rng = np.random.default_rng(band)
    masks = {1: rng.random((23, 17)) < 0.3, 2: rng.random((23, 17)) < 0.5, 3: np.zeros((23, 17), bool), 4: np.zeros((23, 17), bool)}
    masks[3][:, 8] = True  # one column through all bands
    masks[4][::2] = True  # a snake
    for r in range(1, 23, 2):
        masks[4][r, 0 if r % 4 == 1 else 16] = True
    pixels = spark.createDataFrame([(f, int(r), int(c)) for f, m in masks.items() for r, c in zip(*np.nonzero(m))], "frame int, row int, col int")
    runs = label.components(pixels, 23 if wrap else None, band, alone).collect()
    for f, m in masks.items():
        want, wrapped = brute_labels(m, wrap)
        got = np.zeros(m.shape, int)
        for r in runs:
            if r.frame == f:
                got[r.row, r.first : r.last + 1] = r.label
                assert r.wrapped == (r.label in wrapped)
        assert (got == want).all()


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "frame int, row int, col int")
    assert label.components(none, 10).count() == 0
