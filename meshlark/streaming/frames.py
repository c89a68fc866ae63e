"""Frames that arrive in a folder, analysed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshlark.operators import label
from meshlark.sources.discovery import name_pattern
from meshlark.sources.frames import inspect, load_pixels

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str, most_files: int = 64) -> DataFrame:
    """``timepoint, path, content`` of new files of a folder, a bounded number a batch."""
    regex, glob = name_pattern(pattern)
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", most_files).load(folder)
    name = F.regexp_extract(F.substring_index("path", "/", -1), regex, 1)
    return files.select(name.alias("timepoint"), "path", "content").where(F.col("timepoint") != "").withColumn("timepoint", F.col("timepoint").cast("int"))


def summarise(spark: SparkSession, folder: str, pattern: str, output: str, checkpoint: str, background: tuple[float, ...] = (0.0, 2.0), periodic: bool = True) -> StreamingQuery:
    """Appends quality figures of each new frame to a Parquet table, once a frame, until no file is left.

    The checkpoint knows which files are done, so a restarted query goes on where it was; a batch writes to a folder
    of its own number, so one that is repeated after a failure replaces itself."""

    def batch(files: DataFrame, number: int) -> None:
        files = files.persist()
        shapes = inspect(files).select(F.col("timepoint").alias("frame"), "height", "width").persist()
        for shape in shapes.select("height", "width").distinct().collect():
            h, w = shape["height"], shape["width"]
            own = shapes.where((F.col("height") == h) & (F.col("width") == w)).select("frame")
            pixels = load_pixels(files.join(own.withColumnRenamed("frame", "timepoint"), "timepoint", "left_semi"), background)
            found = label.regions(label.components(pixels, h if periodic else None), h, w, periodic)
            quality = own.join(label.quality(label.filter_regions(found)), "frame", "left").fillna(0)
            quality.write.mode("overwrite").parquet(f"{output}/batch={number}/shape={h}x{w}")
        files.unpersist()

    return arriving(spark, folder, pattern).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
