"""The whole analysis of a time series, from foreground pixels to tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.operators import fourier, geometry, label, order, piv, stats, structure
from meshlark.plans.settings import TABLES, Settings
from meshlark.sources.settled import settled

Tables = dict[str, DataFrame]


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c) if c == "frame" else F.col(c).alias(prefix + c) for c in df.columns])


def _joined(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All frames of the first with what the others have of them: one row a frame."""
    return reduce(lambda a, b: a.join(b, "frame", "left"), others, first)


def region_tables(pixels: DataFrame, frames: DataFrame, height: int, width: int, s: Settings) -> Tables:
    """``runs``, ``found`` (all components), ``regions`` (kept ones with psi and smoothing), ``triangles``, ``flags``.

    Each is settled for the tables that follow: one labelling and one tessellation a frame serve all of them."""
    wrap = height if s.periodic else None
    runs = settled(label.components(pixels, wrap))
    found = settled(label.filter_regions(label.regions(runs, height, width, s.periodic), s.filters.min_area, s.filters.max_area, s.filters.exclude_border))
    kept = found.where("kept").select("frame", F.col("new_label").alias("region_id"), "label", F.col("area").cast("double").alias("area"), "row", "col")
    triangles = settled(geometry.triangulate(kept, wrap))
    flags = settled(geometry.boundary(kept, triangles, height, width, s.periodic))
    psi = order.psi(kept, triangles, s.n_fold)
    psi = order.without_boundary(psi, flags) if s.exclude_boundary else psi.join(flags, ["frame", "region_id"])
    regions = settled(kept.join(psi, ["frame", "region_id"]))
    smooth = order.smooth(regions, s.neighbours, height=wrap, include_self=s.include_self)
    regions = settled(regions.join(smooth, ["frame", "region_id"]))
    return {"runs": runs, "found": found, "regions": regions, "triangles": triangles, "flags": flags}


def analyze(spark: SparkSession, pixels: DataFrame, frames: DataFrame, height: int, width: int, s: Settings) -> Tables:
    """Tables by name; beyond labels, tessellation and order nothing runs before a table is used.

    ``pixels`` are the foreground (frame, row, col), ``frames`` the frames there are (frame, path), all of one shape."""
    made = region_tables(pixels, frames, height, width, s)
    regions, base = made["regions"], frames.select("frame")
    value = "smoothed" if s.neighbours > 0 else "psi_mag"
    minutes = (F.col("frame") - s.start) * s.minutes
    cell, area = stats.complex_summary(regions, s.n_fold), stats.complex_summary(regions, s.n_fold, "area")
    means = regions.groupBy("frame").agg(
        F.count("*").alias("region_count"),
        stats.finite_mean("psi_mag").alias("mean_psi_magnitude"),
        stats.weighted_mean("psi_mag", "area").alias("area_weighted_mean_psi_magnitude"),
        stats.finite_mean("smoothed").alias("mean_smoothed_psi_magnitude"),
        stats.weighted_mean("smoothed", "area").alias("area_weighted_mean_smoothed_psi_magnitude"),
    )
    plain = settled(geometry.triangulate(regions)) if s.periodic else made["triangles"]
    counted = made["flags"].groupBy("frame").agg(F.count_if("boundary").alias("voronoi_boundary_count"))
    quality = _joined(frames, label.quality(made["found"]), structure.spacing_qc(regions, plain, height, width), counted).withColumns({f"{k}_foreground_fraction": F.coalesce(F.col(f"{k}_foreground_pixels"), F.lit(0)) / (height * width) for k in ("raw", "retained")})
    tests = _joined(base, stats.pearson(regions, value, periodic=s.periodic), stats.anova(regions, s.bin_size, value))
    tests = stats.benjamini_hochberg(stats.benjamini_hochberg(tests, "correlation_p_value", "correlation_q_value_bh"), "anova_p_value", "anova_q_value_bh")
    shown = regions.withColumn("row", F.pmod(F.col("row") + s.vertical_shift, F.lit(float(height))))
    pixels_ = label.label_pixels(made["runs"]).join(regions.select("frame", "label", "region_id", "re", "im", "psi_mag", "smoothed"), ["frame", "label"])
    out: Tables = {"regions": regions, "order_pixels": pixels_.drop("label"), "segmentation_qc": quality, "spatial_statistics": stats.conclusions(tests, periodic=s.periodic), "row_bins": stats.row_bins(regions, height, s.bin_size, value)}
    if s.periodic:
        bases = [stats.harmonic(shown, height, v, basis=b) for v, b in (("psi_mag", "raw_psi_magnitude"), ("smoothed", "smoothed_psi_magnitude")) if v != "smoothed" or s.neighbours > 0]
        out["spatial_statistics_harmonic"] = stats.benjamini_hochberg(reduce(DataFrame.unionByName, bases), "p_value", "q_value_bh", ["basis"])
    if s.bootstrap.enabled:
        b = s.bootstrap
        out["spatial_block_bootstrap"] = stats.block_bootstrap(regions, height, b.block, b.replicates, b.level, b.seed, s.periodic)
    extended = [means, _prefixed(cell, "complex_psi_cell_"), _prefixed(area, "complex_psi_area_")]
    if s.rectangle is not None:
        x1, x2, y1, y2 = s.rectangle
        if x2 > width or y2 > height:
            raise ValueError(f"the rectangle {s.rectangle} is larger than the images ({height} by {width})")
        h, w = y2 - y1, x2 - x1
        mask = label.label_pixels(made["runs"]).join(made["found"].where("kept").select("frame", "label"), ["frame", "label"], "left_semi").select("frame", "row", "col", F.lit(1.0).alias("value"))
        cut = fourier.crop(fourier.roll_rows(mask, s.vertical_shift, height), s.rectangle)
        grid = settled(_dense(base, cut, h, w))
        spec = settled(fourier.spectrum(grid, h, w))
        out["fourier_bins"] = fourier.top_bins(spec, s.top_bins)
        out["fourier_spectrum"] = fourier.legacy_intensity(spec)
        extended.append(fourier.mean_bin_distance(out["fourier_bins"], base).withColumnRenamed("mean_distance", "fourier_mean_distance"))
        extended.append(fourier.legacy_metric(spec).withColumnRenamed("metric", "fourier_metric"))
        if s.band.enabled:
            band = fourier.band_spectrum(grid, h, w, (s.band.low, s.band.high), s.band.window)
            band = settled(band)
            out["fourier_v2_spectrum"] = band
            out["fourier_v2_pairs"] = fourier.peak_pairs(band, h, w, s.band.top_pairs)
            out["fourier_v2_radial"] = fourier.radial_profile(band, h, w, s.band.radial_width)
            first = out["fourier_v2_pairs"].where("rank = 1").select("frame", F.col("radial").alias("dominant_radial_frequency"), F.col("wavelength").alias("dominant_wavelength_pixels"))
            out["fourier_v2_metrics"] = fourier.band_metrics(band, s.band.low).join(first, "frame", "left")
            extended.append(_prefixed(out["fourier_v2_metrics"], "fourier_v2_"))
    if s.structure.enabled:
        curve = structure.g6_curve(regions, height, width, s.periodic, s.structure.max_spacings, s.structure.bin_spacings)
        curve = settled(curve)
        out["g6_correlation"] = curve
        out["structure_metrics"] = _joined(base, structure.structure_of(regions, made["triangles"], made["flags"]), structure.decay_lengths(curve))
    if s.velocity.enabled:
        out |= _roi(spark, made, frames, height, width, s)
    whole = _joined(frames.withColumn("minutes", minutes), *extended).fillna(0, ["region_count"])
    out["frame_metrics_extended"] = whole
    metric = F.col("fourier_metric") if s.rectangle is not None else F.lit(None).cast("double")
    out["frame_metrics"] = whole.select("frame", "path", "region_count", "mean_psi_magnitude", "mean_smoothed_psi_magnitude", metric.alias("fourier_metric"))
    wanted = {t for name, own in TABLES.items() if getattr(s.outputs, name) for t in own}
    return {name: df for name, df in out.items() if name in wanted}


def _dense(frames: DataFrame, sparse: DataFrame, height: int, width: int) -> DataFrame:
    rows, cols = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (height, width))
    spine = frames.select("frame", rows.alias("row")).select("frame", "row", cols.alias("col"))
    return spine.join(sparse, ["frame", "row", "col"], "left").fillna(0.0, ["value"])


def _roi(spark: SparkSession, made: Tables, frames: DataFrame, height: int, width: int, s: Settings) -> Tables:
    """The polygon at each frame, and the mean of psi inside it; frame t + 1 comes after field t of the run."""
    last = frames.agg(F.max("frame").alias("t")).first()["t"]
    field = spark.read.parquet(s.velocity.path)
    piv.check_shared_grid(field)
    steps = list(range(last - s.start))
    fields = {r["field"] for r in field.select("field").distinct().collect()}
    if missing := [f for f in steps if f not in fields]:
        raise ValueError(f"velocity fields {missing[:5]} are missing")
    path = piv.evolve_polygon(spark, s.velocity.polygon, field.where(F.col("field").between(0, len(steps) - 1)), height, width, s.periodic, s.velocity.method)
    moved = settled(path.select((F.col("step") + s.start).cast("int").alias("frame"), "vertex", "x", "y"))
    pixels = label.value_map(label.label_pixels(made["runs"]), made["regions"], "psi_mag").withColumnRenamed("psi_mag", "value")
    corners = moved.join(frames.select("frame"), "frame").groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("vertex", "x", "y"))).alias("v"))
    polygons = corners.select("frame", F.transform("v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("polygon"))
    inside = piv.roi_series(pixels, polygons, height, width).join(polygons.select("frame", F.to_json("polygon").alias("polygon")), "frame")
    return {"roi_boundaries": moved, "roi_statistics": inside}


def plot_tables(tables: Tables) -> Tables:
    """What plots show: the tables behind histograms, series and curves, ready to draw, of an analysis with all outputs."""
    out = {"histogram": tables["row_bins"], "series": tables["frame_metrics_extended"]}
    q = F.col("anova_q_value_bh")
    floor = tables["spatial_statistics"].agg((F.min(F.when(q > 0, q)) / 2).alias("floor"))
    out["significance"] = tables["spatial_statistics"].join(floor).select("frame", (-F.log10(F.greatest(q, F.coalesce("floor", F.lit(1e-300))))).alias("minus_log10_q"))
    if "g6_correlation" in tables:
        curve = tables["g6_correlation"]
        n = curve.select("frame").distinct().count()
        chosen = sorted({int(i * (n - 1) / 7) for i in range(8)}) if n > 1 else [0]
        place = F.dense_rank().over(Window.orderBy("frame")) - 1
        frames = curve.select("frame").distinct().withColumn("place", place).where(F.col("place").isin(chosen)).select("frame")
        out["curves"] = curve.join(frames, "frame")
    return out
