"""Files, settings, whole runs, resuming and streaming."""

import csv
import json
import math

import numpy as np
import pytest

from meshlark.__main__ import main
from meshlark.operators import piv
from meshlark.plans import analysis, run, settings
from meshlark.sources import discovery, frames
from meshlark.streaming import frames as stream


def image(t, height=120, width=110, s=12.0):
    rng = np.random.default_rng(t)
    out = np.full((height, width), 2, np.uint8)
    for i in range(int(height / (s * math.sqrt(3) / 2))):
        for j in range(int(width / s) - 1):
            r, c = i * s * math.sqrt(3) / 2 + rng.normal(0, 0.7), 6 + j * s + s / 2 * (i % 2) + rng.normal(0, 0.7)
            r, c = int(round(r)) % height, int(round(c))
            for a in range(-1, 2):
                for b in range(-1, 2):
                    if 0 <= c + b < width:
                        out[(r + a) % height, c + b] = 1
    return out


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for t in (1, 2, 4):
        np.save(d / f"a_T{t:04d}_seg.npy", image(t))
    (d / "other.txt").write_text("x")
    return d


def made(folder, **more):
    return settings.merged(settings.Settings(folder=str(folder), output=str(folder.parent / "out"), rectangle=(10, 42, 20, 52)), {"start": 1, "bin_size": 30} | more)


def test_patterns():
    regex, glob = discovery.name_pattern("*T{timepoint:04d}_x?.npy")
    import re

    assert re.match(regex, "aT0012_xy.npy")[1] == "0012" and not re.match(regex, "aT012_xy.npy") and glob == "*T*_x?.npy"
    assert re.match(discovery.name_pattern("f{timepoint}.npy")[0], "f123.npy")[1] == "123"
    for bad in ("plain.npy", "{timepoint:.2f}.npy"):
        with pytest.raises(ValueError):
            discovery.name_pattern(bad)


def test_discovery(spark, folder):
    found = discovery.discover(spark, str(folder), "*T{timepoint:04d}_seg.npy", 1, 4)
    assert sorted(r["timepoint"] for r in found.collect()) == [1, 2, 4]
    assert [r["timepoint"] for r in discovery.missing_timepoints(found, 1, 4).collect()] == [3]
    np.save(folder / "b_T0002_seg.npy", image(2))
    with pytest.raises(ValueError, match="2"):
        discovery.discover(spark, str(folder), "*T{timepoint:04d}_seg.npy")
    with pytest.raises(FileNotFoundError):
        discovery.discover(spark, str(folder), "none{timepoint}.npy")


def test_images(spark, folder):
    np.save(folder / "c_T0009.npy", np.array([[[2, 1, 0], [1, 1, 2]]], np.uint8))
    files = discovery.discover(spark, str(folder), "c_T{timepoint:04d}.npy")
    assert sorted((r["row"], r["col"]) for r in frames.load_pixels(files).collect()) == [(0, 1), (1, 0), (1, 1)]
    assert frames.consistency(frames.inspect(files)).first()["shapes"] == [(2, 3)]
    for name, bad in (("d_T0001.npy", np.zeros((2, 3, 4))), ("e_T0001.npy", np.array([[1.0, np.nan]])), ("f_T0001.npy", np.array([["a"]]))):
        np.save(folder / name, bad)
        with pytest.raises(Exception, match="dimensions|finite|numbers"):
            frames.load_pixels(discovery.discover(spark, str(folder), name[:2] + "T{timepoint:04d}.npy")).collect()


def test_settings(tmp_path):
    s = settings.Settings(folder="in", rectangle=(0, 4, 0, 4))
    settings.write_profile(s, tmp_path / "p.json")
    loaded = settings.load_profile(tmp_path / "p.json")
    assert loaded.folder == str(tmp_path / "in") and loaded.rectangle == (0, 4, 0, 4)
    assert settings.canonical(loaded) == settings.canonical(settings.merged(loaded, {"resume": True}))
    assert settings.merged(s, {"band": {"enabled": True, "low": 0.1, "high": 0.2}}).band.window == "hann"
    for bad in ({"n_fold": True}, {"n_fold": 0}, {"nothing": 1}, {"band": {"enabled": True}}, {"start": 3, "end": 2}, {"rectangle": (3, 1, 0, 1)}, {"minutes": math.inf}, {"filters": {"min_area": 9, "max_area": 2}}, {"resume": True, "velocity": {"enabled": True, "path": "x"}}, {"velocity": {"method": "other"}}):
        with pytest.raises((TypeError, ValueError)):
            settings.merged(s, bad)
    (tmp_path / "q.json").write_text('{"version": 1, "analysis": {"folder": "x", "odd": 1}}')
    with pytest.raises(ValueError, match="odd"):
        settings.load_profile(tmp_path / "q.json")


EXTENDED = ["frame", "path", "minutes", "region_count", "mean_psi_magnitude", "area_weighted_mean_psi_magnitude", "mean_smoothed_psi_magnitude", "area_weighted_mean_smoothed_psi_magnitude"]


def test_run_and_resume(spark, folder):
    s = made(folder, structure={"enabled": True, "max_spacings": 4.0}, bootstrap={"enabled": True, "replicates": 20, "block": 40}, band={"enabled": True, "low": 0.05, "high": 0.3})
    paths = run.run(spark, s)
    assert {"frame_metrics_extended", "segmentation_qc", "spatial_statistics", "spatial_statistics_harmonic", "structure_metrics", "g6_correlation", "fourier_v2_pairs", "spatial_block_bootstrap", "regions"} <= set(paths)
    out = folder.parent / "out"
    lines = (out / "csv/frame_metrics_extended.csv").read_text().splitlines()
    assert lines[0].split(",")[:8] == EXTENDED and [x.split(",")[0] for x in lines[1:]] == ["1", "2", "4"]
    assert all(float(x.split(",")[4]) > 0.5 for x in lines[1:])
    note = json.loads((out / "manifest.json").read_text())
    assert note["status"] == "complete" and note["outputs"] and note["timepoints"] == [1, 2, 4]
    before = {p.name: p.read_bytes() for p in (out / "csv").glob("*.csv")}
    again = run.run(spark, settings.merged(s, {"resume": True}))
    assert set(again) == set(paths) and before == {p.name: p.read_bytes() for p in (out / "csv").glob("*.csv")}
    with pytest.raises(ValueError, match="changed"):
        run.run(spark, settings.merged(s, {"resume": True, "n_fold": 4}))
    small = (out / "csv/frame_metrics.csv").read_text().splitlines()
    assert small[0] == "frame,path,region_count,mean_psi_magnitude,mean_smoothed_psi_magnitude,fourier_metric" and len(small) == 4
    assert set(note["inputs"]) == {r["path"] for r in discovery.discover(spark, s.folder, s.pattern).select("path").collect()}
    spectra = spark.read.parquet(str(out / "parquet/fourier_spectrum"))
    assert spectra.count() == 3 * 32 * 32 and spark.read.parquet(str(out / "parquet/fourier_v2_spectrum")).count() == 3 * 32 * 32
    pixels = spark.read.parquet(str(out / "parquet/order_pixels"))
    assert {"row", "col", "psi_mag", "smoothed"} <= set(pixels.columns) and pixels.select("frame").distinct().count() == 3


class Killed(BaseException):
    pass


class Near(float):
    """Equal to texts of numbers that differ only in how sums were taken."""

    def __eq__(self, other):
        return float(other) == pytest.approx(float(self))


def few(folder, **more):
    wanted = dict.fromkeys(settings.TABLES, False) | {"metrics": True, "statistics": True}
    return made(folder, rectangle=None, step_frames=1, outputs=wanted, **more)


def test_a_killed_run_goes_on(spark, folder, monkeypatch):
    s, out, seen = few(folder), folder.parent / "out", []
    analyze = run.analyze

    def dies(spark, pixels, frames_, *rest):
        seen.append(sorted(r["frame"] for r in frames_.select("frame").collect()))
        if len(seen) == 3:
            raise Killed
        return analyze(spark, pixels, frames_, *rest)

    monkeypatch.setattr(run, "analyze", dies)
    with pytest.raises(Killed):
        run.run(spark, s)
    assert seen == [[1], [2], [4]] and json.loads((out / "manifest.json").read_text())["status"] == "failed"
    assert [list(x["frames"]) for x in json.loads((out / "finished.json").read_text())["steps"]] == [["1"], ["2"]]
    paths = run.run(spark, settings.merged(s, {"resume": True}))
    assert seen == [[1], [2], [4], [4]] and set(paths) == {"frame_metrics", "spatial_statistics"}
    tables = lambda d: {p.name: [x.split(",") for x in p.read_text().splitlines()] for p in (d / "csv").glob("*.csv")}
    number = lambda x: Near(x) if x[:1].isdigit() else x
    resumed = tables(out)
    whole = settings.merged(s, {"output": str(folder.parent / "whole"), "step_frames": 64})
    run.run(spark, whole)
    assert resumed == {n: [[number(x) for x in row] for row in t] for n, t in tables(folder.parent / "whole").items()}
    # what has changed since is refused: an input, then a written file
    resume = settings.merged(s, {"resume": True})
    np.save(folder / "a_T0002_seg.npy", image(5))
    with pytest.raises(ValueError, match="time point 2 has changed"):
        run.run(spark, resume)
    np.save(folder / "a_T0002_seg.npy", image(2))
    part = next((out / "steps").rglob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError, match="has changed since it was written"):
        run.run(spark, resume)


def test_outputs_by_choice(spark, folder, capsys):
    with pytest.raises(ValueError, match="nothing"):
        made(folder, outputs=dict.fromkeys(settings.TABLES, False))
    assert main(["analyze", "--folder", str(folder), "--no-fourier", "--rectangle", "0,8,0,8"], spark) == 2
    assert "contradicts" in capsys.readouterr().err
    with pytest.raises(ValueError, match="different grids"):
        piv.check_shared_grid(spark.createDataFrame([(0, 0.0, 0.0), (0, 1.0, 0.0), (1, 0.0, 0.0), (1, 1.5, 0.0)], "field int, x double, y double"))
    piv.check_shared_grid(spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0)], "field int, x double, y double"))


def test_strict_and_failed_runs(spark, folder):
    with pytest.raises(FileNotFoundError, match="3"):
        run.run(spark, made(folder, end=4, strict_missing=True))
    assert not (folder.parent / "out").exists()
    with pytest.raises(ValueError, match="rectangle"):
        run.run(spark, made(folder, rectangle=(0, 999, 0, 9)))
    assert json.loads((folder.parent / "out/manifest.json").read_text())["status"] == "failed"


def test_regions_of_interest_follow_fields(spark, folder):
    rows = [(t, float(x), float(y), 1.0, 0.0) for t in range(4) for x in range(0, 111, 10) for y in range(0, 121, 10)]
    spark.createDataFrame(rows, "field int, x double, y double, u double, v double").write.parquet(str(folder.parent / "piv"))
    s = made(folder, rectangle=None, velocity={"enabled": True, "path": str(folder.parent / "piv"), "polygon": ((20.0, 20.0), (60.0, 20.0), (60.0, 70.0))})
    files = discovery.discover(spark, s.folder, s.pattern)
    own = frames.inspect(files).selectExpr("timepoint AS frame", "path")
    tables = analysis.analyze(spark, frames.load_pixels(files), own, 120, 110, s)
    found = {(r["frame"], r["vertex"]): r["x"] for r in tables["roi_boundaries"].collect()}
    assert [found[t, 0] for t in (1, 2, 4)] == [20, 21, 23]
    assert all(0 < r["average"] <= 1 for r in tables["roi_statistics"].collect())
    assert {"histogram", "series", "significance"} <= set(analysis.plot_tables(tables))


def test_commands(spark, folder, capsys):
    assert main(["inspect", "--folder", str(folder), "--pattern", "a_T{timepoint:04d}_seg.npy"], spark) == 0
    assert json.loads(capsys.readouterr().out)["one_shape"]
    assert main(["inspect", "--folder", str(folder), "--n-fold", "0"], spark) == 2
    assert not (folder / "analysis").exists()


def test_streaming(spark, folder, tmp_path):
    out, check = str(tmp_path / "stream"), str(tmp_path / "check")
    for extra in (None, 7):
        if extra:
            np.save(folder / f"a_T{extra:04d}_seg.npy", image(extra))
        stream.summarise(spark, str(folder), "a_T{timepoint:04d}_seg.npy", out, check).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["frame"] for r in rows) == [1, 2, 4, 7] and all(r["raw_component_count"] > 50 for r in rows)


def test_large_tables_are_written_in_ranges(spark, tmp_path):
    rows = [(i % 7, i, float("nan") if i % 5 == 0 else i / 4, f'a,"{i}"', i % 2 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "frame int, region_id int, x double, name string, flag boolean").repartition(5)
    whole, parts = str(tmp_path / "whole.csv"), str(tmp_path / "parts.csv")
    assert run.write_csv(df, whole) == whole
    run.write_csv(df, parts, rows=40)
    read = lambda f: list(csv.reader(f.read_text().splitlines()))
    one = read(tmp_path / "whole.csv")
    files = sorted((tmp_path / "parts.csv").glob("part-*"))
    assert len(files) > 4 and all(read(f)[0] == one[0] for f in files)
    assert [r for f in files for r in read(f)[1:]] == one[1:]
    assert [(int(r[0]), int(r[1])) for r in one[1:]] == sorted((r[0], r[1]) for r in rows)
    # again in its place, and an empty table
    run.write_csv(df.where("frame = 3"), parts)
    assert len(read(tmp_path / "parts.csv")) == 1 + sum(r[0] == 3 for r in rows)
    run.write_csv(df.where("false"), whole)
    assert read(tmp_path / "whole.csv") == [["frame", "region_id", "x", "name", "flag"]]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".parts") and not p.name.endswith(".crc")]


def test_headers_are_read_without_images(spark, tmp_path):
    (tmp_path / "odd place %").mkdir()
    for t, (h, w) in enumerate([(3, 4), (900, 1100), (5, 6)]):
        np.save(tmp_path / "odd place %" / f"a b+{t:04d}.npy", np.ones((h, w), np.uint16 if t else np.float32))
    files = discovery.discover(spark, str(tmp_path / "odd place %"), "a b+{timepoint:04d}.npy")
    got = {r.timepoint: r for r in frames.inspect(files).collect()}
    assert [(got[t].height, got[t].width, got[t].dtype) for t in range(3)] == [(3, 4, "float32"), (900, 1100, "uint16"), (5, 6, "uint16")]
    assert all(r.bytes_read <= frames.HEAD for r in got.values())
    plan = frames.inspect(files)._jdf.queryExecution().executedPlan().toString()
    assert any("content" not in line for line in plan.splitlines() if "binaryFile" in line)
    # a store that tasks can't open: whole files, the same answers
    far = files.selectExpr("timepoint", "'far:' || path AS path", "content")
    assert {(r.timepoint, r.height, r.width) for r in frames.inspect(far).collect()} == {(t, r.height, r.width) for t, r in got.items()}
    np.save(tmp_path / "odd place %" / "a b+0009.npy", np.ones((2, 3, 4)))
    with pytest.raises(Exception, match="2 dimensions"):
        frames.inspect(discovery.discover(spark, str(tmp_path / "odd place %"), "a b+{timepoint:04d}.npy")).collect()


def test_arrows_of_velocity_fields(spark, tmp_path, capsys):
    rows = [(f, float(x), float(y), 3.0 * f, 4.0 * f if (x, y) != (2, 2) else None) for f in (1, 2) for x in range(5) for y in range(4)]
    fields = str(tmp_path / "fields")
    spark.createDataFrame(rows, "field int, x double, y double, u double, v double").write.parquet(fields)
    assert main(["piv-frames", fields, str(tmp_path / "out"), "--step", "2"], spark) == 0
    paths = json.loads(capsys.readouterr().out)
    arrows = spark.read.parquet(paths["arrows"]).collect()
    assert len(arrows) == 2 * 3 * 2 and {r.speed for r in arrows} == {3.0, 5.0, 6.0, 10.0}
    assert tuple(spark.read.parquet(paths["speed_range"]).first()) == (5.0, 10.0)
    assert main(["piv-frames", fields, str(tmp_path / "out"), "--step", "0"], spark) == 2
    assert main(["piv-frames", str(tmp_path / "none"), str(tmp_path / "out")], spark) == 2
