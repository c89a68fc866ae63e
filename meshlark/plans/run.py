"""Runs: discovery, analysis in steps, tables on disk, a manifest, and resuming."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark import __version__
from meshlark.operators import stats
from meshlark.plans.analysis import Tables, analyze
from meshlark.plans.settings import Settings, canonical, write_text
from meshlark.sources import discovery, frames
from meshlark.sources.settled import scratch, settled

#: Tables that depend on all frames of a run; they are made again from the others when a run is resumed.
ADJUSTED = {"spatial_statistics": [("correlation_p_value", "correlation_q_value_bh", None), ("anova_p_value", "anova_q_value_bh", None)], "spatial_statistics_harmonic": [("p_value", "q_value_bh", ["basis"])]}

#: Tables with a row a pixel or frequency: Parquet only.
PIXELS = frozenset(("order_pixels", "fourier_spectrum", "fourier_v2_spectrum"))


#: Rows of one CSV part.
CSV_ROWS = 1_000_000


def signature(settings: Settings) -> str:
    """A digest of the settings and the version; inputs are compared frame by frame."""
    return hashlib.sha256(f"{canonical(settings)}|{__version__}".encode()).hexdigest()


def digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def run(spark: SparkSession, settings: Settings, tables: list[str] | None = None) -> dict[str, str]:
    """Analyses a folder and writes each table as Parquet and as one CSV file; returns their paths.

    Frames are analysed in steps of ``step_frames``.  A step that is written is recorded with the digests of its inputs
    and files, so a run that dies can be resumed: recorded frames are not analysed again.  A run whose settings differ
    from those recorded, or whose recorded inputs or files have changed, is refused.  What depends on all frames is made
    from all steps at the end.  The manifest says running, complete or failed, and lists inputs and outputs."""
    settings.check()
    out = Path(settings.output or f"{settings.folder}/analysis")
    files = discovery.discover(spark, settings.folder, settings.pattern, settings.start, settings.end)
    sums = {r["timepoint"]: (r["path"], r["sha256"]) for r in discovery.checksums(files).collect()}
    found = sorted(sums)
    missing = [r["timepoint"] for r in discovery.missing_timepoints(files.select("timepoint"), settings.start, settings.end).collect()] if settings.end is not None else []
    if missing and settings.strict_missing:
        raise FileNotFoundError(f"time points are missing: {sorted(missing)}")
    began, record = time.time(), _record(out, settings, sums)
    note = {"version": __version__, "signature": record["signature"], "settings": json.loads(canonical(settings)), "timepoints": found, "missing": sorted(missing), "started": datetime.now(timezone.utc).isoformat()}
    note["inputs"] = {path: sha for path, sha in sums.values()}
    manifest = out / "manifest.json"
    write_text(manifest, json.dumps(note | {"status": "running"}, indent=2, allow_nan=False))
    try:
        done = {int(t) for step in record["steps"] for t in step["frames"]}
        todo = [t for t in found if t not in done]
        size = len(found) if settings.velocity.enabled else settings.step_frames  # a polygon's way goes through all frames
        for at in range(0, len(todo), max(1, size)):
            own = todo[at : at + size]
            folder = out / "steps" / f"{own[0]:06d}-{uuid.uuid4().hex[:8]}"
            with scratch(spark):
                made = _by_shape(spark, files.where(F.col("timepoint").isin(own)), settings)
                for name, df in made.items():
                    df.write.parquet(str(folder / name))
            kept = {str(p.relative_to(out)): digest(p) for p in sorted(folder.rglob("*.parquet"))}
            record["steps"].append({"folder": str(folder.relative_to(out)), "tables": sorted(made), "frames": {str(t): sums[t][1] for t in own}, "files": kept})
            write_text(out / "finished.json", json.dumps(record))
        paths = _combine(spark, record, out, settings, tables)
    except BaseException as e:
        write_text(manifest, json.dumps(note | {"status": "failed", "error": str(e)[:2000]}, indent=2, allow_nan=False))
        raise
    outputs = {str(p.relative_to(out)): digest(p) for p in sorted([*(out / "csv").rglob("*.csv"), *(out / "parquet").rglob("*.parquet")])}
    write_text(manifest, json.dumps(note | {"status": "complete", "seconds": time.time() - began, "outputs": outputs}, indent=2, allow_nan=False))
    return paths


def _record(out: Path, settings: Settings, sums: dict[int, tuple[str, str]]) -> dict:
    """The steps that are done; none for a run from the beginning."""
    sign, path = signature(settings), out / "finished.json"
    fresh = {"signature": sign, "steps": []}
    if settings.resume and path.exists():
        old = json.loads(path.read_text())
        if old["signature"] != sign:
            raise ValueError("settings have changed since the run that is to be resumed")
        for step in old["steps"]:
            for t, sha in step["frames"].items():
                if sums.get(int(t), ("", ""))[1] != sha:
                    raise ValueError(f"the input of time point {t} has changed since it was analysed")
            for name, sha in step["files"].items():
                if not (out / name).exists() or digest(out / name) != sha:
                    raise ValueError(f"{name} has changed since it was written")
        return old
    if settings.resume and out.exists() and any(p.name != "manifest.json" for p in out.iterdir()):
        raise ValueError(f"{out} has files but no run to resume")
    write_text(path, json.dumps(fresh))
    return fresh


def _by_shape(spark: SparkSession, files: DataFrame, settings: Settings) -> Tables:
    """Frames of each shape are analysed together; there are as many plans as shapes."""
    seen = settled(frames.inspect(files))
    parts = []
    for shape in seen.select("height", "width").distinct().orderBy("height", "width").collect():
        own = seen.where((F.col("height") == shape["height"]) & (F.col("width") == shape["width"])).select(F.col("timepoint").alias("frame"), "path")
        pixels = frames.load_pixels(files.join(own.select(F.col("frame").alias("timepoint")), "timepoint", "left_semi"), settings.background)
        parts.append(analyze(spark, pixels, own, shape["height"], shape["width"], settings))
    return {name: reduce(lambda a, b: a.unionByName(b), [p[name] for p in parts]) for name in parts[0]}


def _combine(spark: SparkSession, record: dict, out: Path, settings: Settings, tables: list[str] | None) -> dict[str, str]:
    """Tables of all steps together, with what is adjusted over all frames adjusted anew."""
    paths = {}
    for name in sorted({t for step in record["steps"] for t in step["tables"]}):
        if tables and name not in tables:
            continue
        df = spark.read.parquet(*[str(out / step["folder"] / name) for step in record["steps"] if name in step["tables"]])
        for p, q, family in ADJUSTED.get(name, []):
            df = stats.benjamini_hochberg(df.drop(q), p, q, family)
        if name == "spatial_statistics":
            df = stats.conclusions(df, periodic=settings.periodic)
        target = out / "parquet" / name
        df.write.mode("overwrite").parquet(str(target))
        paths[name] = write_csv(spark.read.parquet(str(target)), str(out / "csv" / f"{name}.csv")) if name not in PIXELS else str(target)
    return paths


def write_csv(df: DataFrame, path: str, rows: int = CSV_ROWS) -> str:
    """A table in the order of its first columns, with a header; missing and NaN are empty.

    Executors sort and write ranges of about ``rows`` rows.  A table of one range is one file; a larger one is a folder of
    that name, whose parts are in order.  The result is renamed into its place when it is whole."""
    keys = [c for c in ("frame", "basis", "metric", "bin", "rank", "region_id", "vertex") if c in df.columns] or df.columns[:1]
    plain = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])
    parts = max(1, -(-df.count() // rows))
    ranged = plain.repartitionByRange(parts, *keys) if parts > 1 else plain.coalesce(1)
    spark = df.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    made = hadoop.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    ranged.sortWithinPartitions(*keys).write.option("header", True).option("emptyValue", "").option("escape", "\"").csv(made.toString())
    fs = target.getFileSystem(conf)
    # empty ranges write no file
    files = sorted((f.getPath() for f in fs.listStatus(made) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    if not files:
        header = hadoop.Path(made, "part-00000.csv")
        stream = fs.create(header)
        stream.write(bytearray((",".join(df.columns) + "\n").encode()))
        stream.close()
        files = [header]
    fs.delete(target, True)
    if parts == 1:
        fs.rename(files[0], target)
        fs.delete(made, True)
    else:
        fs.rename(made, target)
    return path
