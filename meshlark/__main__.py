"""``python -m meshlark analyze | inspect | piv-frames``: only options that are given override a profile."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshlark.operators import piv
from meshlark.plans.run import run
from meshlark.plans.settings import Outputs, Settings, load_profile, merged
from meshlark.sources import discovery, frames


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="meshlark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("analyze", "inspect"):
        p = commands.add_parser(name, argument_default=argparse.SUPPRESS)
        p.add_argument("--profile")
        for option, kind in (("folder", str), ("output", str), ("pattern", str), ("start", int), ("end", int), ("n-fold", int), ("neighbours", int), ("vertical-shift", int), ("bin-size", int), ("top-bins", int), ("minutes", float), ("step-frames", int)):
            p.add_argument(f"--{option}", type=kind)
        p.add_argument("--rectangle", type=lambda x: tuple(map(int, x.split(","))), help="x1,x2,y1,y2")
        p.add_argument("--background", type=lambda x: tuple(map(float, x.split(","))))
        p.add_argument("--no-fourier", action="store_true", help="no rectangle, no spectra")
        for f in fields(Outputs):
            p.add_argument(f"--save-{f.name.replace('_', '-')}", dest=f"save_{f.name}", action=argparse.BooleanOptionalAction)
        for option in ("periodic", "exclude-boundary", "include-self", "strict-missing", "resume"):
            p.add_argument(f"--{option}", action=argparse.BooleanOptionalAction)
    arrows = commands.add_parser("piv-frames", help="the arrows and the range of speeds that pictures of velocity fields show")
    arrows.add_argument("fields", help="Parquet of field, x, y, u, v")
    arrows.add_argument("output")
    arrows.add_argument("--step", type=int, default=2, help="every so many samples along both axes")
    return parser


def piv_frames(spark: SparkSession, fields: str, output: str, step: int = 2) -> dict[str, str]:
    """Writes ``arrows`` (field, x, y, u, v, speed) and ``speed_range`` (low, high over all fields), and returns their paths."""
    if step < 1:
        raise ValueError("--step is at least 1")
    field = spark.read.parquet(fields)
    piv.check_shared_grid(field)
    made = {"arrows": piv.quiver(field, step).withColumn("speed", F.hypot("u", "v")), "speed_range": piv.speed_range(field)}
    paths = {name: f"{output.rstrip('/')}/{name}" for name in made}
    for name, df in made.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(_parser().parse_args(arguments))
    command, profile = given.pop("command"), given.pop("profile", None)
    try:
        if command == "piv-frames":
            spark = spark or SparkSession.builder.appName("meshlark").getOrCreate()
            print(json.dumps(piv_frames(spark, **given), indent=2))
            return 0
        base = load_profile(profile) if profile else Settings(folder=given.get("folder", ""))
        if given.pop("no_fourier", False):
            if "rectangle" in given or base.band.enabled:
                raise ValueError("--no-fourier contradicts a rectangle or band that is asked for")
            given["rectangle"] = None
        wanted = {name.removeprefix("save_"): given.pop(name) for name in [x for x in given if x.startswith("save_")]}
        settings = merged(base, given | ({"outputs": wanted} if wanted else {}))
        spark = spark or SparkSession.builder.appName("meshlark").getOrCreate()
        if command == "analyze":
            print(json.dumps(run(spark, settings), indent=2))
        else:
            files = discovery.discover(spark, settings.folder, settings.pattern, settings.start, settings.end)
            row = frames.consistency(frames.inspect(files)).first()
            print(json.dumps(row.asDict(recursive=True), indent=2))
    except (ValueError, TypeError, OSError, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
