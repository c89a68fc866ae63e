"""Time points: from file names, missing ones and repeated ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for itself, what stands for other characters, and the field.
_TOKEN = re.compile(r"(?P<field>\{timepoint[^}]*\})|(?P<many>\*)|(?P<one>\?)|(?P<text>.)", re.S)


def _digits(field: str) -> str:
    """The group for a field: ``{timepoint}``, ``{timepoint:d}``, or with a width, ``{timepoint:04d}``."""
    form = field[len("{timepoint") : -1]
    if form in ("", ":d"):
        return "([0-9]+)"
    if not re.fullmatch(r":[0-9]+d", form) or not int(form[1:-1]):
        raise ValueError(f"the time point has an integer format, not {form!r}")
    return f"([0-9]{{{int(form[1:-1])}}})"


def name_pattern(pattern: str) -> tuple[str, str]:
    """(regular expression with the time point as group 1, glob) of a pattern such as ``f_{timepoint:04d}*.npy``.

    ``*`` and ``?`` match as in a shell; a width asks for exactly so many digits.  There is one field."""
    regex, glob, fields = "", "", 0
    for token in _TOKEN.finditer(pattern):
        kind, said = token.lastgroup, token[0]
        fields += kind == "field"
        regex += _digits(said) if kind == "field" else ".*" if kind == "many" else "." if kind == "one" else re.escape(said)
        glob += "*" if kind == "field" else said
    if fields != 1:
        raise ValueError("a pattern has one {timepoint} field")
    return f"^{regex}$", glob


def missing_timepoints(found: DataFrame, start: int, end: int) -> DataFrame:
    """Time points of the closed range that ``found`` doesn't have."""
    wanted = found.sparkSession.range(start, end + 1).select(F.col("id").cast("int").alias("timepoint"))
    return wanted.join(found.select(F.col("timepoint").cast("int")), "timepoint", "left_anti")


def duplicate_timepoints(found: DataFrame) -> DataFrame:
    """Time points that occur more than once, with how often."""
    return found.groupBy("timepoint").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def discover(spark: SparkSession, folder: str, pattern: str, start: int = 0, end: int | None = None) -> DataFrame:
    """``timepoint, path, length, content``: the folder's files (not those below) whose names match, in the range.

    Contents are read only if a later step uses them.  Raises if nothing matches or two files have one time point."""
    regex, glob = name_pattern(pattern)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)
    name = F.substring_index("path", "/", -1)
    found = files.withColumn("timepoint", F.regexp_extract(name, regex, 1)).where(F.col("timepoint") != "").withColumn("timepoint", F.col("timepoint").cast("int"))
    found = found.where(F.col("timepoint") >= start)
    if end is not None:
        found = found.where(F.col("timepoint") <= end)
    twice = duplicate_timepoints(found.select("timepoint")).orderBy("timepoint").take(5)
    if twice:
        raise ValueError(f"several files have the time points {[r['timepoint'] for r in twice]}")
    if found.select("timepoint").isEmpty():
        raise FileNotFoundError(f"no file in {folder} matches {pattern}")
    return found.select("timepoint", "path", "length", "content")


def checksums(found: DataFrame) -> DataFrame:
    """``timepoint, path, sha256`` of discovered files."""
    return found.select("timepoint", "path", F.sha2("content", 256).alias("sha256"))
