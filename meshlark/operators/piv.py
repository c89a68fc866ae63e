"""Velocity fields: interpolation at points, and polygons carried along by them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.operators.interpolate import EDGE, cubic, linear, planes
from meshlark.operators.joins import nearest_join
from meshlark.operators.quantiles import BOUND, grouped_quantiles
from meshlark.operators.stats import finite
from meshlark.sources.settled import settled

POLYGON = "array<struct<x:double,y:double>>"


def _samples(field: DataFrame) -> DataFrame:
    return field.where(finite("u") & finite("v") & finite("x") & finite("y"))


def check_shared_grid(field: DataFrame) -> None:
    """Raises unless all velocity fields have their samples at the same places, each once.

    Places are compared to about nine digits; missing coordinates are equal to each other."""
    near = lambda c: F.when(finite(c), F.round(F.col(c), 9)).otherwise(F.lit(None)).alias(c)
    places = field.select("field", near("x"), near("y"))
    n = places.agg(F.count_distinct("field").alias("n")).first()["n"]
    odd = places.groupBy("x", "y").agg(F.count_distinct("field").alias("fields"), F.count("*").alias("rows")).where((F.col("fields") != n) | (F.col("rows") != F.col("fields")) & F.col("x").isNotNull() & F.col("y").isNotNull())
    bad = odd.take(1)
    if bad:
        raise ValueError(f"velocity fields have different grids: ({bad[0]['x']}, {bad[0]['y']}) is in {bad[0]['fields']} of {n} fields, {bad[0]['rows']} times")


def nearest(points: DataFrame, field: DataFrame) -> DataFrame:
    """Velocity of the nearest sample (ties by x, then y) at points (field, point, x, y)."""
    s = _samples(field).select("field", F.col("x").alias("sx"), F.col("y").alias("sy"), "u", "v")
    return nearest_join(points, s, "field", "point", ("u", "v")).select("field", "point", "x", "y", "u", "v")


def inverse_distance(points: DataFrame, field: DataFrame) -> DataFrame:
    """Mean of all samples weighted by 1 / distance squared; a sample at the point itself decides alone.

    All samples of a field have a part in each of its points, so this compares all of them; sums are partial."""
    s = _samples(field).select("field", F.col("x").alias("sx"), F.col("y").alias("sy"), "u", "v")
    d2 = F.pow(F.col("x") - F.col("sx"), F.lit(2)) + F.pow(F.col("y") - F.col("sy"), F.lit(2))
    hit = F.sqrt("d2") <= 1e-12
    w = F.when(~hit, 1 / F.col("d2"))
    sums = points.join(s, "field").withColumn("d2", d2).groupBy("field", "point", "x", "y").agg(F.min(F.when(hit, F.struct("sx", "sy", "u", "v"))).alias("own"), F.sum(w).alias("w"), F.sum(w * F.col("u")).alias("wu"), F.sum(w * F.col("v")).alias("wv"))
    return sums.select("field", "point", "x", "y", F.coalesce(F.col("own.u"), F.col("wu") / F.col("w")).alias("u"), F.coalesce(F.col("own.v"), F.col("wv") / F.col("w")).alias("v"))


METHODS = {"nearest": nearest, "inverse_distance": inverse_distance, "bilinear": linear, "bicubic": cubic}


def _carried(field: DataFrame, method: str) -> tuple[DataFrame, str]:
    """``field, held``: what a field's velocities are made from, as an array of structures, and the velocity at ``way.x, way.y``
    from it, as an SQL expression of a structure with u and v."""
    if method == "bilinear":
        at = lambda c: f"t.{c}[0] + t.{c}[1] * way.x + t.{c}[2] * way.y"
        inside = f"struct(least({at('b0')}, {at('b1')}, {at('b2')}) AS depth, {at('u')} AS u, {at('v')} AS v)"
        best = f"array_max(transform(held, t -> {inside}))"
        return planes(field).groupBy("field").agg(F.collect_list("t").alias("held")), f"if({best}.depth >= {-EDGE!r}D, {best}, NULL)"
    samples = _samples(field).groupBy("field").agg(F.array_sort(F.collect_list(F.struct("x", "y", "u", "v"))).alias("held"))
    d2 = "power(t.x - way.x, 2) + power(t.y - way.y, 2)"
    nearest_ = f"array_min(transform(held, t -> struct({d2} AS d2, t.x AS x, t.y AS y, t.u AS u, t.v AS v)))"
    if method == "nearest":
        return samples, nearest_
    total = lambda c: f"aggregate(held, 0D, (a, t) -> a + {c} / ({d2}))"
    mean = f"named_struct('u', {total('t.u')} / {total('1D')}, 'v', {total('t.v')} / {total('1D')})"
    return samples, f"if(sqrt({nearest_}.d2) <= 1e-12D, named_struct('u', {nearest_}.u, 'v', {nearest_}.v), {mean})"


def evolve_polygon(spark: SparkSession, polygon: Sequence[tuple[float, float]], field: DataFrame, height: float, width: float, periodic: bool = False, method: str = "bilinear") -> DataFrame:
    """``step, vertex, x, y``: the polygon before the first field and after each field in turn, in the order of ``field``.

    A step depends on where the one before has led, so this is one recursive query: the vertices meet the next field, which
    is one row with what its velocities are made from (a grid's samples or triangles).  Nothing of it passes the driver but
    the number of fields.  x is clamped to the image, y too unless rows wrap; outside of all samples a vertex stays.
    ``bicubic`` has no such row, so its steps are settled one by one."""
    start = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(polygon)], "vertex int, x double, y double")
    if method == "bicubic":
        return _evolve_by_steps(start, field, height, width, periodic, method)
    held, velocity = _carried(field, method)
    every = field.select("field").distinct().select("field", F.row_number().over(Window.orderBy("field")).alias("step"))
    fields = settled(every.join(held, "field", "left").select("step", "held"))
    y = f"pmod(way.y + coalesce(v.v, 0D), {float(height)!r}D)" if periodic else f"greatest(0D, least({height - 1.0!r}D, way.y + coalesce(v.v, 0D)))"
    return spark.sql(
        f"""WITH RECURSIVE way (step, vertex, x, y) MAX RECURSION LEVEL {fields.count() + 2} AS (
          SELECT 0 AS step, vertex, x, y FROM {{start}}
          UNION ALL
          SELECT step, vertex, greatest(0D, least({width - 1.0!r}D, way.x + coalesce(v.u, 0D))) AS x, {y} AS y
          FROM (SELECT f.step, way.vertex, way.x, way.y, {velocity} AS v FROM way JOIN {{fields}} f ON f.step = way.step + 1) way)
        SELECT step, vertex, x, y FROM way""",
        start=start,
        fields=fields,
    )


def _evolve_by_steps(here: DataFrame, field: DataFrame, height: float, width: float, periodic: bool, method: str) -> DataFrame:
    """As :func:`evolve_polygon`, a settled job a field; only field numbers are on the driver."""
    out = [here.select(F.lit(0).alias("step"), "vertex", "x", "y")]
    for step, row in enumerate(field.select("field").distinct().orderBy("field").toLocalIterator(), 1):
        moved = METHODS[method](here.select(F.lit(row["field"]).alias("field"), F.col("vertex").alias("point"), "x", "y"), field.where(F.col("field") == row["field"])).select(F.col("point").alias("vertex"), "u", "v")
        x, y = F.col("x") + F.coalesce("u", F.lit(0.0)), F.col("y") + F.coalesce("v", F.lit(0.0))
        x = F.greatest(F.lit(0.0), F.least(F.lit(width - 1.0), x))
        y = F.pmod(y, F.lit(float(height))) if periodic else F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), y))
        here = settled(here.join(moved, "vertex", "left").select("vertex", x.alias("x"), y.alias("y")))
        out.append(here.select(F.lit(step).alias("step"), "vertex", "x", "y"))
    return reduce(DataFrame.unionByName, out)


def in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule with half-open edges: a pixel centre on a lower or left edge is inside, on others outside."""
    if len(polygon) < 3:
        raise ValueError("a polygon has at least three vertices")
    inside = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y1 == y2:
            continue
        crosses = ((F.lit(y1) <= y) != (F.lit(y2) <= y)) & (x < F.lit(float(x1)) + (y - y1) * ((x2 - x1) / (y2 - y1)))
        inside = inside + crosses.cast("int")
    return inside % 2 == 1


def roi_statistics(pixels: DataFrame, polygon: Sequence[tuple[float, float]], height: int, width: int, value: str = "value") -> DataFrame:
    """Mean of finite values inside the polygon, its pixels, and those with a value, per frame."""
    inside = pixels.where(in_polygon(F.col("col").cast("double"), F.col("row").cast("double"), polygon))
    ok = finite(value)
    area = sum(_inside(c, r, polygon) for r in range(height) for c in range(width)) if height * width <= 1 << 16 else None
    found = inside.groupBy("frame").agg(F.avg(F.when(ok, F.col(value))).alias("average"), F.count_if(ok).alias("valid_pixels"))
    spine = pixels.select("frame").distinct()
    if area is None:
        grid = pixels.sparkSession.range(height * width).select((F.col("id") % width).cast("double").alias("x"), F.floor(F.col("id") / width).cast("double").alias("y"))
        area = grid.where(in_polygon(F.col("x"), F.col("y"), polygon)).count()
    return spine.join(found, "frame", "left").select("frame", "average", F.lit(area).cast("long").alias("geometric_pixels"), F.coalesce("valid_pixels", F.lit(0)).cast("long").alias("valid_pixels"))


def _crossings(polygon: Column, y: Column) -> Column:
    """Where the edges of a polygon (array of x, y) cross the line at y, by half-open edges, in order."""
    n = F.size(polygon)
    edges = F.transform(polygon, lambda a, i: F.struct(a.alias("a"), F.get(polygon, F.pmod(i + 1, n)).alias("b")))
    met = F.filter(edges, lambda e: (e["a"]["y"] <= y) != (e["b"]["y"] <= y))
    return F.array_sort(F.transform(met, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * ((e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"]))))


def roi_series(pixels: DataFrame, polygons: DataFrame, height: int, width: int, value: str = "value") -> DataFrame:
    """:func:`roi_statistics` with a polygon of its own for each frame: ``polygons`` has frame and ``polygon``, an array
    of (x, y).  One plan for all frames; the geometric area is summed up line by line."""
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    inside = pixels.join(polygons.select("frame", "polygon"), "frame").where(F.pmod(F.size(F.filter(_crossings(F.col("polygon"), y), lambda c: x < c)), F.lit(2)) == 1)
    ok = finite(value)
    found = inside.groupBy("frame").agg(F.avg(F.when(ok, F.col(value))).alias("average"), F.count_if(ok).alias("valid_pixels"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(float(width)), F.ceil(c).cast("double")))
    lines = polygons.select("frame", "polygon", F.explode(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: y.cast("double"))).alias("y")).select("frame", _crossings(F.col("polygon"), F.col("y")).alias("at"))
    # inside lies between the first and second crossing, the third and fourth, and so on
    signed = F.transform("at", lambda c, i: F.when(i % 2 == 1, clip(c)).otherwise(-clip(c)))
    areas = lines.groupBy("frame").agg(F.sum(F.aggregate(signed, F.lit(0.0), lambda a, c: a + c)).cast("long").alias("geometric_pixels"))
    return areas.join(found, "frame", "left").select("frame", "average", "geometric_pixels", F.coalesce("valid_pixels", F.lit(0)).cast("long").alias("valid_pixels"))


def _inside(x: float, y: float, polygon: Sequence[tuple[float, float]]) -> bool:
    odd = False
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y1 != y2 and (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)):
            odd = not odd
    return odd


def speed_range(field: DataFrame, bound: int = BOUND) -> DataFrame:
    """2nd and 98th percentile of speed over all fields; the upper is one more if they are the same."""
    speed = F.hypot("u", "v")
    p = grouped_quantiles(field.where(finite(speed)), [], {"low": (speed, 0.02), "high": (speed, 0.98)}, bound=bound)
    return p.select("low", F.when(F.col("high") <= F.col("low"), F.col("low") + 1).otherwise(F.col("high")).alias("high"))


def quiver(field: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th sample along both axes, with 0 for what is not finite."""
    place = lambda a: F.dense_rank().over(Window.partitionBy("field").orderBy(a)) - 1
    ranked = field.withColumn("ix", place("x")).withColumn("iy", place("y")).where((F.col("ix") % step == 0) & (F.col("iy") % step == 0))
    return ranked.select("field", "x", "y", *[F.when(finite(c), F.col(c)).otherwise(0.0).alias(c) for c in ("u", "v")])
