"""Defects, detection quality, and the correlation of orientational order with distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators.geometry import neighbours
from meshlark.operators.joins import knn_self_join, range_self_join
from meshlark.operators.quantiles import BOUND, grouped_quantiles
from meshlark.operators.stats import finite
from meshlark.sources.settled import settled

THRESHOLD = 1 / math.e


def coordination(points: DataFrame, edges: DataFrame, flags: DataFrame) -> DataFrame:
    """``frame, region_id, z, interior``: distinct neighbours; interior regions are off the boundary with all of theirs."""
    near = edges.join(flags.select("frame", F.col("region_id").alias("dst"), F.col("boundary").alias("far")), ["frame", "dst"])
    seen = near.groupBy("frame", F.col("src").alias("region_id")).agg(F.count("*").alias("z"), F.bool_or("far").alias("beside"))
    joined = flags.join(seen, ["frame", "region_id"], "left")
    return joined.select("frame", "region_id", F.coalesce("z", F.lit(0)).alias("z"), (~F.col("boundary") & ~F.coalesce("beside", F.lit(False))).alias("interior"))


def defects(z: DataFrame, edges: DataFrame) -> DataFrame:
    """Per frame: shares of coordination numbers among interior regions, charges, and how defects stand together.

    A defect is an interior region with z other than 6; partners must be such defects too.  Shares are null without
    interior regions, clustering is null without defects."""
    bad = z.where(F.col("interior") & (F.col("z") != 6)).select("frame", "region_id", F.signum(6 - F.col("z")).alias("sign"))
    ends = edges.join(bad.select("frame", F.col("region_id").alias("src"), F.col("sign").alias("a")), ["frame", "src"]).join(bad.select("frame", F.col("region_id").alias("dst"), F.col("sign").alias("b")), ["frame", "dst"])
    met = ends.groupBy("frame", F.col("src").alias("region_id")).agg(F.bool_or(F.col("a") == -F.col("b")).alias("opposite"))
    joined = z.join(met, ["frame", "region_id"], "left")
    inside, c = F.col("interior"), F.col("z")
    share = lambda test: F.avg(F.when(inside, F.when(test, 1.0).otherwise(0.0)))
    defect = inside & (c != 6)
    among = lambda test: F.avg(F.when(defect, F.when(test, 1.0).otherwise(0.0)))
    return joined.groupBy("frame").agg(
        F.count_if(inside).alias("interior_regions"),
        F.avg(F.when(inside, c)).alias("mean_coordination"),
        share(c <= 4).alias("fraction_z4_or_less"),
        share(c == 5).alias("fraction_z5"),
        share(c == 6).alias("fraction_z6"),
        share(c == 7).alias("fraction_z7"),
        share(c >= 8).alias("fraction_z8_or_more"),
        share(c != 6).alias("defect_fraction"),
        F.avg(F.when(inside, F.abs(6 - c))).alias("mean_abs_charge"),
        F.avg(F.when(inside, 6 - c)).alias("net_charge_per_region"),
        among(F.col("opposite").isNotNull()).alias("defect_neighbor_fraction"),
        among(F.coalesce("opposite", F.lit(False))).alias("dislocation_fraction"),
    )


def structure_of(points: DataFrame, triangles: DataFrame, flags: DataFrame) -> DataFrame:
    edges = neighbours(triangles)
    return defects(coordination(points, edges, flags), edges)


def spacing_qc(points: DataFrame, triangles: DataFrame, height: float, width: float, hole_factor: float = 1.0, bound: int = BOUND) -> DataFrame:
    """Nearest-neighbour distance, its spread, its ratio to the mean spacing, and the share of area in large triangles.

    The margin of three medians and the hole threshold use the median over all points, the figures only inner points;
    fewer than ten of either give nulls.  ``triangles`` are those of the frame without wrapping."""
    near = knn_self_join(points, 1).select("frame", F.col("i").alias("region_id"), F.sqrt("d2").alias("d"))
    own = settled(points.join(near, ["frame", "region_id"]).select("frame", "row", "col", "d"))
    d = F.col("d")
    medians = grouped_quantiles(own, ["frame"], {"median": (d, 0.5)}, [F.count("*").alias("n")], bound)
    medians = medians.where(F.col("n") >= 10).withColumn("margin", 3 * F.col("median"))
    within = lambda r, c: (r > F.col("margin")) & (r < height - F.col("margin")) & (c > F.col("margin")) & (c < width - F.col("margin"))
    central = own.join(medians, "frame").where(within(F.col("row"), F.col("col")))
    inner = grouped_quantiles(central, ["frame"], {"mid": (d, 0.5)}, [F.count("*").alias("m"), (F.stddev_pop("d") / F.avg("d")).alias("cv"), F.first("n").alias("n")], bound)
    inner = inner.where(F.col("m") >= 10)
    center = lambda x: (F.col(f"{x}0") + F.col(f"{x}1") + F.col(f"{x}2")) / 3
    kept = triangles.join(medians, "frame").where(within(center("row"), center("col")))
    holes = kept.groupBy("frame").agg(F.sum("area").alias("total"), F.sum(F.when(F.col("circumradius") > hole_factor * F.col("median"), F.col("area")).otherwise(0.0)).alias("holes"))
    out = inner.join(holes, "frame", "left").select(
        "frame",
        F.col("mid").alias("median_nn_distance_pixels"),
        F.col("cv").alias("nn_distance_cv"),
        (F.col("mid") / F.sqrt(F.lit(float(height * width)) / F.col("n"))).alias("nn_distance_ratio"),
        F.when(F.col("total") > 0, F.col("holes") / F.col("total")).alias("hole_area_fraction"),
    )
    return points.select("frame").distinct().join(out, "frame", "left")


def g6_curve(order: DataFrame, height: float, width: float, periodic: bool, max_spacings: float = 15.0, bin_spacings: float = 0.25) -> DataFrame:
    """``frame, bin, r, g6, g6_normalized, pairs, spacing``: the mean of Re psi_i conj(psi_j) over pairs by distance.

    ``order`` has row, col, re, im by frame and region.  Bins are in units of the mean spacing over all regions of the
    frame, up to ``max_spacings`` or half the width (or height, if rows wrap); a last, shorter bin reaches the largest
    distance.  Every bin is there, empty ones with null; frames with fewer than two regions or no order have none."""
    limit = width / 2 if not periodic else min(width, height) / 2
    ok = finite("re") & finite("im")
    frames = order.groupBy("frame").agg(F.count("*").alias("n"), F.avg(F.when(ok, F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("psi2")).where((F.col("n") >= 2) & (F.col("psi2") > 0))
    frames = frames.withColumn("spacing", F.sqrt(F.lit(float(height * width)) / F.col("n"))).withColumn("top", F.least(max_spacings * F.col("spacing"), F.lit(limit)))
    frames = frames.withColumn("w", F.least(bin_spacings * F.col("spacing"), F.col("top")))
    # edges 0, w, 2w, ... below top + w / 2, and top itself if they stop short of it
    steps = F.ceil((F.col("top") + F.col("w") / 2) / F.col("w") - 1e-12) - 1
    frames = frames.withColumn("bins", (steps + F.when(steps * F.col("w") < F.col("top"), 1).otherwise(0)).cast("int")).withColumn("steps", steps)
    pairs = range_self_join(order.where(ok).join(frames.select("frame", "top"), "frame"), F.col("top"), height if periodic else None, keep=("re", "im"))
    binned = pairs.join(frames.select("frame", "w", "bins"), "frame").withColumn("bin", F.least(F.floor(F.col("distance") / F.col("w")), F.col("bins") - 1).cast("int"))
    sums = binned.groupBy("frame", "bin").agg(F.avg(F.col("re_i") * F.col("re_j") + F.col("im_i") * F.col("im_j")).alias("g6"), F.count("*").alias("pairs"))
    spine = frames.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    edge = lambda i: F.when(i > F.col("steps"), F.col("top")).otherwise(i * F.col("w"))
    r = (edge(F.col("bin")) + edge(F.col("bin") + 1)) / 2
    return spine.join(sums, ["frame", "bin"], "left").select("frame", "bin", r.alias("r"), "g6", (F.col("g6") / F.col("psi2")).alias("g6_normalized"), F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"), "spacing")


def decay_lengths(curve: DataFrame, fit_floor: float = 0.05) -> DataFrame:
    """Decay scales of each frame's normalized curve.

    From 0.75 spacings on: where it first falls below 1/e (by line between bins; an upper bound if it begins there).
    Exponential and power-law fits of its logarithm use one spacing and more, before the first bin below
    ``fit_floor``, and at least three positive bins.  One short curve a frame."""
    by_r = Window.partitionBy("frame").orderBy("r")
    upto = by_r.rowsBetween(Window.unboundedPreceding, 0)
    g, r = F.col("g6_normalized"), F.col("r")
    used = curve.where(finite("g6_normalized") & (r >= 0.75 * F.col("spacing")))
    used = used.withColumn("g0", F.lag(g).over(by_r)).withColumn("r0", F.lag(r).over(by_r)).withColumn("stopped", F.coalesce(F.max((r >= F.col("spacing")) & (g < fit_floor)).over(upto), F.lit(False)))
    crossing = F.when(g < THRESHOLD, F.struct(r.alias("r"), F.when(F.col("g0").isNull(), r).otherwise(F.col("r0") + (THRESHOLD - F.col("g0")) * (r - F.col("r0")) / (g - F.col("g0"))).alias("xi"), F.col("g0").isNull().alias("bound")))
    fit = (r >= F.col("spacing")) & ~F.col("stopped") & (g > 0)
    y, x, lx = F.when(fit, F.ln(g)), F.when(fit, r), F.when(fit, F.ln(r))
    grouped = used.groupBy("frame").agg(F.min(crossing).alias("first"), F.count_if(fit).alias("n"), F.regr_slope(y, x).alias("es"), F.regr_r2(y, x).alias("e2"), F.regr_slope(y, lx).alias("ps"), F.regr_r2(y, lx).alias("p2"))
    enough = F.col("n") >= 3
    out = grouped.select(
        "frame",
        F.col("first")["xi"].alias("xi_1e_pixels"),
        F.coalesce(F.col("first")["bound"], F.lit(False)).alias("xi_1e_is_upper_bound"),
        F.when(enough & (F.col("es") < 0), -1 / F.col("es")).alias("exp_xi_pixels"),
        F.when(enough, F.col("e2")).alias("exp_r_squared"),
        F.when(enough, -F.col("ps")).alias("power_eta"),
        F.when(enough, F.col("p2")).alias("power_r_squared"),
    )
    frames = curve.groupBy("frame").agg(F.first("spacing").alias("spacing"))
    joined = frames.join(out, "frame", "left").withColumn("xi_1e_is_upper_bound", F.coalesce("xi_1e_is_upper_bound", F.lit(False)))
    per: Column = F.col("xi_1e_pixels") / F.col("spacing")
    return joined.withColumn("xi_1e_spacings", per)
