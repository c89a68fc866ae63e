"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: its lineage ends here, and a lost executor costs no more than its own tasks.

    The folder is ``spark.checkpoint.dir``, or what ``SparkContext.setCheckpointDir`` was given.  Without either, a
    session on one machine makes a temporary one; on a cluster this fails, since other machines would miss such a
    folder.  Shuffle files of the write go with it."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="meshlark-")
        sc.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that were settled inside: for when what came from them is written."""
    first = len(_folders)
    try:
        yield
    finally:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        while len(_folders) > first:
            path = fs.Path(_folders.pop())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
