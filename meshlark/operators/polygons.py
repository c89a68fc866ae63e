"""Grids and points seen through a polygon, padding, and polygons on rolled images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.operators.piv import in_polygon

Polygon = Sequence[tuple[float, float]]


def _at_pixel(polygon: Polygon):
    return in_polygon(F.col("col").cast("double"), F.col("row").cast("double"), polygon)


def crop_to_polygon(grid: DataFrame, polygon: Polygon) -> DataFrame:
    """Dense pixels (frame, row, col, value) within the polygon's bounds, from its corner, 0 outside the polygon.

    Bounds are those of the pixels inside, so they are clipped to the image; they are one row, joined to all pixels."""
    inside = grid.where(_at_pixel(polygon))
    box = inside.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    held = grid.join(F.broadcast(box), F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1")))
    return held.select("frame", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), F.when(_at_pixel(polygon), F.col("value")).otherwise(0.0).alias("value"))


def centroid_impulses(regions: DataFrame, polygon: Polygon, height: int, width: int) -> DataFrame:
    """``frame, row, col`` of the pixels nearest to centroids (halves to even) that lie in the image and the polygon."""
    near = regions.select("frame", F.rint("row").cast("int").alias("row"), F.rint("col").cast("int").alias("col")).distinct()
    return near.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1) & _at_pixel(polygon))


def pad_center(grid: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """Dense pixels in the middle of a larger image of zeros; an odd rest goes below and to the right."""
    if to_height < height or to_width < width:
        raise ValueError("the padded image is at least as large")
    y, x = (to_height - height) // 2, (to_width - width) // 2
    moved = grid.select("frame", (F.col("row") + y).alias("row"), (F.col("col") + x).alias("col"), "value")
    rows, cols = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (to_height, to_width))
    spine = grid.select("frame").distinct().select("frame", rows.alias("row")).select("frame", "row", cols.alias("col"))
    return spine.join(moved, ["frame", "row", "col"], "left").fillna(0.0, ["value"])


def to_display(vertices: DataFrame, height: float, shift: int) -> DataFrame:
    """Vertices on the image whose rows are rolled down by ``shift``."""
    return vertices.withColumn("y", F.pmod(F.col("y") + shift, F.lit(float(height))))


def from_display(vertices: DataFrame, height: float, shift: int) -> DataFrame:
    return to_display(vertices, height, -shift)
