"""Registered queries: every operator over the driver's tables, in fixed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.operators import fourier, geometry, label, order, piv, polygons, stats, structure
from meshlark.operators.joins import range_self_join
from meshlark.sources import adapters, discovery
from meshlark.sources.settled import settled

SIDE, DAY = adapters.SIDE, adapters.DAY
HOURS, DAYS = 24, 30
POLYGON = ((3.0, 2.0), (20.0, 4.0), (26.0, 15.0), (12.0, 21.0), (5.0, 13.0))
BAND = (0.08, 0.3)


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, without negative zeros, so that equal results are equal values."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(F.col(c), own.get(c, digits)) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def _embedded(spark: SparkSession, sf_dir: str, wrap: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Points, and their triangles, settled: ridges, flags and neighbours all come from one tessellation."""
    points = adapters.regions_of_embeddings(spark, sf_dir)
    return points, settled(geometry.triangulate(points, wrap))


def _ordered(spark: SparkSession, sf_dir: str, wrap: float | None = None) -> DataFrame:
    points, triangles = _embedded(spark, sf_dir, wrap)
    return settled(points.join(order.psi(points, triangles), ["frame", "region_id"]))


def harmonic_daily(spark, sf_dir):
    found = stats.harmonic(adapters.regions_of_events(spark, sf_dir), DAY)
    return rounded(stats.benjamini_hochberg(found, "p_value", "q_value", ["basis"]), peak_row=2)


def anova_daily(spark, sf_dir):
    found = stats.anova(adapters.regions_of_events(spark, sf_dir), 3600)
    return rounded(stats.benjamini_hochberg(found, "anova_p_value", "anova_q_value_bh"))


def pearson_daily(spark, sf_dir):
    found = stats.pearson(adapters.regions_of_events(spark, sf_dir))
    return rounded(stats.benjamini_hochberg(found, "correlation_p_value", "correlation_q_value_bh"))


def conclusions(spark, sf_dir):
    regions = adapters.regions_of_events(spark, sf_dir)
    both = stats.pearson(regions).join(stats.anova(regions, 3600), "frame")
    both = stats.benjamini_hochberg(stats.benjamini_hochberg(both, "correlation_p_value", "correlation_q_value_bh"), "anova_p_value", "anova_q_value_bh")
    return stats.conclusions(both, alpha=0.5).select("frame", "pearson_conclusion", "anova_conclusion")


def row_bins(spark, sf_dir):
    return rounded(stats.row_bins(adapters.regions_of_events(spark, sf_dir), DAY, 5000))


def complex_summary_cell(spark, sf_dir):
    return rounded(stats.complex_summary(adapters.regions_of_lineitems(spark, sf_dir), 6))


def complex_summary_area(spark, sf_dir):
    return rounded(stats.complex_summary(adapters.regions_of_lineitems(spark, sf_dir), 6, "weight"))


def area_summary(spark, sf_dir):
    return rounded(stats.area_summary(adapters.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice").withColumnRenamed("l_returnflag", "frame"), 4)


def finite_and_weighted_means(spark, sf_dir):
    return rounded(adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("frame")).agg(stats.finite_mean("l_discount").alias("mean_value"), stats.weighted_mean("l_discount", "l_quantity").alias("weighted_value")))


def delaunay_triangles(spark, sf_dir):
    _, t = _embedded(spark, sf_dir)
    return rounded(t.select("frame", F.array_sort(F.array("id0", "id1", "id2")).alias("t"), "circumradius", "area").select("frame", F.get("t", F.lit(0)).alias("i"), F.get("t", F.lit(1)).alias("j"), F.get("t", F.lit(2)).alias("k"), "circumradius", "area"), 3)


def voronoi_psi6(spark, sf_dir):
    points, t = _embedded(spark, sf_dir)
    return rounded(order.psi(points, t, 6), 5)


def voronoi_boundary(spark, sf_dir):
    points, t = _embedded(spark, sf_dir)
    return geometry.boundary(points, t, SIDE, SIDE, periodic=False)


def voronoi_neighbours(spark, sf_dir):
    _, t = _embedded(spark, sf_dir)
    return geometry.neighbours(t)


def coordination_defects(spark, sf_dir):
    points, t = _embedded(spark, sf_dir)
    return rounded(structure.structure_of(points, t, geometry.boundary(points, t, SIDE, SIDE, periodic=False)))


def spacing_qc(spark, sf_dir):
    points = adapters.regions_of_embeddings(spark, sf_dir)
    shifted = points.withColumns({"row": (F.col("row") - 250) * 2, "col": (F.col("col") - 250) * 2})
    return rounded(structure.spacing_qc(shifted, settled(geometry.triangulate(shifted)), SIDE, SIDE))


def knn_smooth(spark, sf_dir):
    return rounded(order.smooth(_ordered(spark, sf_dir), 6), 5)


def boundary_excluded_smooth(spark, sf_dir):
    points, t = _embedded(spark, sf_dir)
    masked = order.without_boundary(order.psi(points, t), geometry.boundary(points, t, SIDE, SIDE, periodic=False))
    return rounded(order.smooth(settled(points.join(masked, ["frame", "region_id"])), 3, include_self=True), 5)


def pairs_in_range(spark, sf_dir):
    return rounded(range_self_join(adapters.regions_of_embeddings(spark, sf_dir), 25.0))


def pairs_in_range_wrapped(spark, sf_dir):
    """Events of a day by user and second, pairs at most an hour or five users apart in scaled distance."""
    points = adapters.regions_of_events(spark, sf_dir).select("frame", "region_id", (F.col("row") / 60).alias("row"), F.col("col"))
    return rounded(range_self_join(points, 20.0, height=DAY / 60))


def g6_curve(spark, sf_dir):
    return rounded(structure.g6_curve(_ordered(spark, sf_dir), SIDE, SIDE, periodic=False, max_spacings=4.0), 5)


def decay_lengths(spark, sf_dir):
    return rounded(structure.decay_lengths(structure.g6_curve(_ordered(spark, sf_dir), SIDE, SIDE, periodic=False, max_spacings=4.0, bin_spacings=0.5)), 3)


def voronoi_psi6_periodic(spark, sf_dir):
    points, t = _embedded(spark, sf_dir, SIDE)
    return rounded(order.psi(points, t, 6), 5)


def voronoi_neighbours_periodic(spark, sf_dir):
    _, t = _embedded(spark, sf_dir, SIDE)
    return geometry.neighbours(t)


def knn_smooth_periodic(spark, sf_dir):
    return rounded(order.smooth(_ordered(spark, sf_dir, SIDE), 6, height=SIDE), 5)


def g6_curve_periodic(spark, sf_dir):
    """At the default 15 spacings, or half the side."""
    return rounded(structure.g6_curve(_ordered(spark, sf_dir, SIDE), SIDE, SIDE, periodic=True), 5)


def bootstrap_ci(spark, sf_dir):
    regions = _ordered(spark, sf_dir).withColumn("area", F.lit(1.0))
    return rounded(stats.block_bootstrap(regions, SIDE, block=100, replicates=200, seed=7))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = adapters.grid_of_events(spark, sf_dir)
    return label.components(grid.where("foreground").select("frame", "row", "col"), height=HOURS)


def components_grid(spark, sf_dir):
    return rounded(label.regions(_labelled(spark, sf_dir), HOURS, DAYS, periodic=True).select("frame", "label", "area", "row", "col"))


def component_filter_qc(spark, sf_dir):
    found = label.regions(_labelled(spark, sf_dir), HOURS, DAYS, periodic=True)
    return rounded(label.quality(label.filter_regions(found, 2, 40, True)))


def border_filter(spark, sf_dir):
    found = label.regions(_labelled(spark, sf_dir), HOURS, DAYS, periodic=True)
    return label.filter_regions(found, exclude_border=True).select("frame", "label", "rejected_border", F.coalesce("new_label", F.lit(0)).alias("new_label"))


def label_map(spark, sf_dir):
    runs = _labelled(spark, sf_dir)
    areas = label.regions(runs, HOURS, DAYS, periodic=True).select("frame", "label", "area")
    return label.value_map(label.label_pixels(runs), areas, "area")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.dense_grid(adapters.grid_of_events(spark, sf_dir), HOURS, DAYS)


def roll_rows(spark, sf_dir):
    return fourier.roll_rows(adapters.grid_of_events(spark, sf_dir), 7, HOURS).select("frame", "row", "col", "n")


def rectangle_crop(spark, sf_dir):
    return fourier.center_crop(_dense(spark, sf_dir), 10, HOURS, DAYS).select("frame", "row", "col", "value")


def roi_stats(spark, sf_dir):
    return rounded(piv.roi_statistics(adapters.grid_of_events(spark, sf_dir).withColumn("value", F.when(F.col("foreground"), F.col("n").cast("double"))), POLYGON, HOURS, DAYS))


def polygon_crop(spark, sf_dir):
    return polygons.crop_to_polygon(_dense(spark, sf_dir), POLYGON)


def polygon_fourier(spark, sf_dir):
    """The legacy metric of the polygon's bounding box, outside set to zero."""
    return rounded(fourier.legacy_metric(fourier.spectrum(polygons.crop_to_polygon(_dense(spark, sf_dir), POLYGON), 19, 23)))


def centroid_impulses(spark, sf_dir):
    found = label.regions(_labelled(spark, sf_dir), HOURS, DAYS, periodic=True)
    return polygons.centroid_impulses(found, POLYGON, HOURS, DAYS)


def pad_center(spark, sf_dir):
    return polygons.pad_center(_dense(spark, sf_dir), HOURS, DAYS, 29, 32)


def polygon_display(spark, sf_dir):
    vertices = adapters.velocities_of_lineitems(spark, sf_dir).select("field", "x", "y")
    shown = polygons.to_display(vertices, 7, 3).withColumnRenamed("y", "shown_y")
    return shown.withColumn("back_y", F.pmod(F.col("shown_y") - 3, F.lit(7.0)))


def dft_v1_top_bins(spark, sf_dir):
    spec = fourier.spectrum(_dense(spark, sf_dir), HOURS, DAYS)
    return rounded(fourier.top_bins(spec, 10, digits=3).select("frame", "rank", "fr", "fc", "intensity", "distance"), 3)


def dft_v1_mean_distance(spark, sf_dir):
    grid = _dense(spark, sf_dir)
    return rounded(fourier.mean_bin_distance(fourier.top_bins(fourier.spectrum(grid, HOURS, DAYS), 10, digits=3), grid))


def dft_v1_metric(spark, sf_dir):
    return rounded(fourier.legacy_metric(fourier.spectrum(_dense(spark, sf_dir), HOURS, DAYS)))


def _band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fourier.band_spectrum(_dense(spark, sf_dir), HOURS, DAYS, BAND)


def dft_v2_band(spark, sf_dir):
    return rounded(fourier.band_metrics(_band(spark, sf_dir), BAND[0]))


def dft_v2_pairs(spark, sf_dir):
    return rounded(fourier.peak_pairs(_band(spark, sf_dir), HOURS, DAYS, 5), 5)


def radial_profile(spark, sf_dir):
    return rounded(fourier.radial_profile(_band(spark, sf_dir), HOURS, DAYS), 5)


def reconstruct(spark, sf_dir):
    bins = fourier.top_bins(fourier.spectrum(_dense(spark, sf_dir), HOURS, DAYS), 4, digits=3)
    return rounded(fourier.reconstruct(bins, HOURS, DAYS), 5)


def _moved_points(field: DataFrame) -> DataFrame:
    return field.select("field", (F.col("x") * 10 + F.col("y")).cast("int").alias("point"), (F.col("x") + 0.3).alias("x"), (F.col("y") + 0.4).alias("y"))


def _interpolated(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        field = adapters.velocities_of_lineitems(spark, sf_dir)
        return rounded(piv.METHODS[method](_moved_points(field), field), 10 if method == "bilinear" else 6)

    return query


def _drifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points, and samples that their own velocity has carried off the grid; those of few rows are missing."""
    field = adapters.velocities_of_lineitems(spark, sf_dir, least=12)
    every = settled(field)
    drift = lambda p, v: (F.col(p) + F.lit(4.0) * F.coalesce(v, F.lit(0.0))).alias(p)
    return _moved_points(every), every.select("field", drift("x", "u"), drift("y", "v"), "u", "v")


def piv_scattered(spark, sf_dir):
    return rounded(piv.METHODS["bilinear"](*_drifted(spark, sf_dir)))


def piv_bicubic(spark, sf_dir):
    return rounded(piv.METHODS["bicubic"](*_drifted(spark, sf_dir)), 5)


def roi_evolve(spark, sf_dir):
    """A triangle carried through all months of shipping, each a field."""
    field = settled(adapters.velocities_of_lineitems(spark, sf_dir).withColumns({c: F.col(c) * 100 for c in ("u", "v")}))
    return rounded(piv.evolve_polygon(spark, [(0.5, 1.5), (3.2, 2.0), (2.0, 6.1)], field, height=8.0, width=5.0, periodic=True, method="nearest"), 5)


def piv_percentiles(spark, sf_dir):
    return rounded(piv.speed_range(adapters.velocities_of_lineitems(spark, sf_dir)))


def piv_quiver(spark, sf_dir):
    return rounded(piv.quiver(adapters.velocities_of_lineitems(spark, sf_dir), 2))


def missing_timepoints(spark, sf_dir):
    """Days without orders between the first and the last day with some."""
    days = adapters.days_of_orders(spark, sf_dir)
    ends = days.agg(F.min("timepoint").alias("first"), F.max("timepoint").alias("last")).first()
    return discovery.missing_timepoints(days, ends["first"] or 0, ends["last"] or 0)


def duplicate_timepoints(spark, sf_dir):
    return discovery.duplicate_timepoints(adapters.table(spark, sf_dir, "orders").select(F.datediff("o_orderdate", F.lit("1992-01-01")).alias("timepoint")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        harmonic_daily, anova_daily, pearson_daily, conclusions, row_bins, complex_summary_cell, complex_summary_area, area_summary,
        finite_and_weighted_means, delaunay_triangles, voronoi_psi6, voronoi_boundary, voronoi_neighbours, coordination_defects, spacing_qc,
        knn_smooth, boundary_excluded_smooth, voronoi_psi6_periodic, voronoi_neighbours_periodic, knn_smooth_periodic, g6_curve_periodic, pairs_in_range, pairs_in_range_wrapped, g6_curve, decay_lengths, bootstrap_ci, components_grid,
        component_filter_qc, border_filter, label_map, roll_rows, rectangle_crop, polygon_crop,
        polygon_fourier, centroid_impulses, pad_center, polygon_display, roi_stats, dft_v1_top_bins, dft_v1_mean_distance, dft_v1_metric, dft_v2_band,
        dft_v2_pairs, radial_profile, reconstruct, roi_evolve, piv_scattered, piv_bicubic, piv_percentiles, piv_quiver, missing_timepoints, duplicate_timepoints,
    )
} | {f"piv_{m}": _interpolated(m) for m in ("nearest", "inverse_distance", "bilinear")}
