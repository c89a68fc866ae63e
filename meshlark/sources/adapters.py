"""Ordinary tables as frames of points, grids and velocity fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Height and width of the square into which embeddings are mapped.
SIDE = 1000.0
DAY = 86400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame = label; the first two components are row and column."""
    e = lambda i: (F.get("embedding", F.lit(i)).cast("double") + 1.0) * 500.0
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("frame"), F.col("vec_id").alias("region_id"), e(0).alias("row"), e(1).alias("col"))


def regions_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame = day of the month, row = second of the day (which wraps), col = user, value = value."""
    ts = F.col("ts")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return table(spark, sf_dir, "events").select(F.dayofmonth(ts).alias("frame"), F.col("event_id").alias("region_id"), seconds.cast("double").alias("row"), F.col("user_id").cast("double").alias("col"), "value")


def grid_of_events(spark: SparkSession, sf_dir: str, least: int = 4) -> DataFrame:
    """frame = event type; pixel (hour, day - 1) with its count of events, and whether it is foreground."""
    hours = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("frame"), F.hour("ts").alias("row"), (F.dayofmonth("ts") - 1).alias("col")).agg(F.count("*").alias("n"))
    return hours.withColumn("foreground", F.col("n") >= least)


def dense_grid(grid: DataFrame, height: int, width: int, value: str = "n") -> DataFrame:
    """Every pixel of every frame, 0 where the grid has none."""
    rows = F.explode(F.sequence(F.lit(0), F.lit(height - 1)))
    cols = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    spine = grid.select("frame").distinct().select("frame", rows.alias("row")).select("frame", "row", cols.alias("col"))
    return spine.join(grid.select("frame", "row", "col", F.col(value).cast("double").alias("value")), ["frame", "row", "col"], "left").fillna(0.0, ["value"])


def velocities_of_lineitems(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """field = month of shipping since January 1992; x = quantity band, y = line number; u, v = centred mean discount and tax,
    missing where a place has fewer than ``least`` rows."""
    month = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1
    band = F.floor((F.col("l_quantity") - 1) / 10)
    cells = table(spark, sf_dir, "lineitem").groupBy(month.alias("field"), band.cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y"))
    mean = lambda c, centre: F.when(F.count("*") >= least, F.avg(c) - centre)
    return cells.agg(mean("l_discount", 0.05).alias("u"), mean("l_tax", 0.04).alias("v"))


def regions_of_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame = return flag and line status; psi has the phase 2 pi * discount * 10 and the magnitude 1 - tax."""
    phase = F.col("l_discount") * (20.0 * 3.141592653589793)
    size = 1 - F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("frame"), (size * F.cos(phase)).alias("re"), (size * F.sin(phase)).alias("im"), F.col("l_quantity").alias("weight"))


def days_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """timepoint = day since 1992, n = orders."""
    return table(spark, sf_dir, "orders").groupBy(F.datediff("o_orderdate", F.lit("1992-01-01")).alias("timepoint")).agg(F.count("*").alias("n"))
