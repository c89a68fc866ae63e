"""Bond-orientational order of regions, and its smoothing over nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.operators.geometry import ridges
from meshlark.operators.joins import knn_self_join
from meshlark.operators.stats import finite


def psi(points: DataFrame, triangles: DataFrame, n_fold: int = 6, by: str = "frame", key: str = "region_id") -> DataFrame:
    """``frame, region_id, re, im, psi_mag``: the mean of exp(i n theta) over finite ridges, weighted by their squared
    length.  Regions without such ridges have 0."""
    w = F.when(F.col("finite") & (F.col("ridge_len2") > 0), F.col("ridge_len2"))
    angle = F.col("theta") * n_fold
    sums = ridges(triangles).groupBy("frame", F.col("src").alias("region_id")).agg(F.sum(w).alias("w"), F.sum(w * F.cos(angle)).alias("c"), F.sum(w * F.sin(angle)).alias("s"))
    every = points.select(F.col(by).alias("frame"), F.col(key).alias("region_id")).join(sums, ["frame", "region_id"], "left")
    part = lambda c: F.coalesce(F.col(c) / F.col("w"), F.lit(0.0))
    return every.select("frame", "region_id", part("c").alias("re"), part("s").alias("im")).withColumn("psi_mag", F.hypot("re", "im"))


def without_boundary(order: DataFrame, flags: DataFrame) -> DataFrame:
    """Boundary regions keep their row and lose their values."""
    joined = order.join(flags, ["frame", "region_id"])
    return joined.withColumns({c: F.when(~F.col("boundary"), F.col(c)) for c in ("re", "im", "psi_mag")})


def smooth(points: DataFrame, k: int, value: str = "psi_mag", height: float | None = None, include_self: bool = False, by: str = "frame", key: str = "region_id") -> DataFrame:
    """``frame, region_id, smoothed``: the mean of the ``k`` nearest other regions' values (and its own if asked).

    Regions without a finite value neither give nor get one; a region alone, or k = 0, keeps its own."""
    ok = points.where(finite(value)).select(F.col(by).alias("frame"), F.col(key).alias("region_id"), "row", "col", F.col(value).alias("__v"))
    if k == 0:
        means = ok.select("frame", "region_id", F.col("__v").alias("smoothed"))
    else:
        near = knn_self_join(ok, k, height, keep=("__v",)).groupBy("frame", F.col("i").alias("region_id")).agg(F.sum("__v_j").alias("s"), F.count("*").alias("n"))
        own = F.lit(1 if include_self else 0)
        mean = (F.col("s") + own * F.col("__v")) / (F.col("n") + own)
        means = ok.join(near, ["frame", "region_id"], "left").select("frame", "region_id", F.coalesce(mean, F.col("__v")).alias("smoothed"))
    return points.select(F.col(by).alias("frame"), F.col(key).alias("region_id")).join(means, ["frame", "region_id"], "left")
