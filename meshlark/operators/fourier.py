"""Two-dimensional spectra of grids, and what is read from them.

The transform is separable: each image row is transformed by itself, then each column of what comes out.  A task holds
one line at a time, and a grid of h x w pixels is shuffled twice, whatever the number of frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The coefficients of cos(2 pi k n / (size - 1)) of the window functions.
WINDOWS = {"none": (1.0,), "hann": (0.5, -0.5), "hamming": (0.54, -0.46), "blackman": (0.42, -0.5, 0.08)}


def crop(grid: DataFrame, rect: tuple[int, int, int, int]) -> DataFrame:
    """Pixels of the half-open rectangle (x1, x2, y1, y2), with rows and columns from its corner."""
    x1, x2, y1, y2 = rect
    if min(x1, y1) < 0 or x2 <= x1 or y2 <= y1:
        raise ValueError(f"a rectangle has increasing bounds from zero on: {rect}")
    inside = (F.col("row") >= y1) & (F.col("row") < y2) & (F.col("col") >= x1) & (F.col("col") < x2)
    return grid.where(inside).withColumns({"row": F.col("row") - y1, "col": F.col("col") - x1})


def roll_rows(grid: DataFrame, by: int, height: int) -> DataFrame:
    """Rows moved down, those that leave at the bottom come back at the top."""
    return grid.withColumn("row", F.pmod(F.col("row") + by, F.lit(height)))


def center_crop(grid: DataFrame, size: int, height: int, width: int) -> DataFrame:
    h, w = min(size, height), min(size, width)
    y, x = (height - h) // 2, (width - w) // 2
    return crop(grid, (x, x + w, y, y + h))


def window_value(i: Column, size: int, name: str) -> Column:
    if name not in WINDOWS:
        raise ValueError(f"unknown window {name!r}; there are {', '.join(sorted(WINDOWS))}")
    if size == 1 or name == "none":
        return F.lit(1.0)
    return sum((F.lit(c) * F.cos(i * (2 * math.pi * k / (size - 1))) for k, c in enumerate(WINDOWS[name])), F.lit(0.0))


def _transformed(cells: DataFrame, line: str, at: str, size: int, out: str) -> DataFrame:
    """``frame``, ``line`` and one row for each frequency ``out``, with ``re, im``: the transform of each line of cells.

    Cells that are not there count as 0."""
    lines = cells.groupBy("frame", line).agg(F.collect_list(F.struct(F.col(at).cast("int").alias("at"), "re", "im")).alias("cells"))
    low, numbers = -(size // 2), pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            re, im = [], []
            for own in batch.column(2):
                place, x, y = (own.values.field(i).to_numpy() for i in range(3))
                values = np.zeros(size, complex)
                values[place] = x + 1j * y
                turned = np.roll(np.fft.fft(values), -low)
                re.append(turned.real)
                im.append(turned.imag)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(re, numbers), pa.array(im, numbers)], names=["frame", line, "re", "im"])

    kinds = dict(lines.dtypes)
    made = lines.mapInArrow(run, f"frame {kinds['frame']}, {line} {kinds[line]}, re array<double>, im array<double>")
    opened = made.select("frame", line, F.posexplode(F.arrays_zip("re", "im")).alias("at", "z"))
    return opened.select("frame", line, (F.col("at") + low).alias(out), F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def spectrum(grid: DataFrame, height: int, width: int) -> DataFrame:
    """``frame, fr, fc, re, im``: signed frequencies (cycles over the grid) of (frame, row, col, value), 0 where the grid
    has no value.

    Equal to a forward transform with a negative exponent, zero frequency in the middle."""
    cells = grid.select("frame", "row", "col", F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return _transformed(_transformed(cells, "row", "col", width, "fc"), "fc", "row", height, "fr").select("frame", "fr", "fc", "re", "im")


def legacy_intensity(spec: DataFrame) -> DataFrame:
    """Adds ``intensity``, the squared modulus, zero at zero frequency."""
    dc = (F.col("fr") == 0) & (F.col("fc") == 0)
    return spec.withColumn("intensity", F.when(dc, 0.0).otherwise(F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def legacy_metric(spec: DataFrame) -> DataFrame:
    """Largest over mean intensity of the whole array, 0 where there is none."""
    both = legacy_intensity(spec).groupBy("frame").agg(F.max("intensity").alias("m"), F.avg("intensity").alias("a"))
    return both.select("frame", F.when(F.col("a") > 0, F.col("m") / F.col("a")).otherwise(0.0).alias("metric"))


def top_bins(spec: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The ``k`` strongest bins of each frame with rank and distance from the centre; never zero frequency.

    Real input gives equal pairs, so ties (after rounding) go by row and column."""
    some = legacy_intensity(spec).where((F.col("fr") != 0) | (F.col("fc") != 0)).withColumn("__i", F.round("intensity", digits))
    rank = F.row_number().over(Window.partitionBy("frame").orderBy(F.col("__i").desc(), "fr", "fc"))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).drop("__i").withColumn("distance", F.hypot("fr", "fc"))


def mean_bin_distance(bins: DataFrame, frames: DataFrame) -> DataFrame:
    """``frame, mean_distance``: mean distance of selected bins from the centre, null for frames without any."""
    means = bins.groupBy("frame").agg(F.avg("distance").alias("mean_distance"))
    return frames.select("frame").distinct().join(means, "frame", "left")


def reconstruct(bins: DataFrame, height: int, width: int) -> DataFrame:
    """``frame, row, col, value``: the modulus of the inverse transform of selected bins, scaled to a maximum of 1."""
    angle = (F.col("fr") * F.col("row") / float(height) + F.col("fc") * F.col("col") / float(width)) * (2 * math.pi)
    pixels = bins.select("frame", "fr", "fc", "re", "im").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    sums = pixels.groupBy("frame", "row", "col").agg(F.sum(F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)).alias("a"), F.sum(F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)).alias("b")).withColumn("value", F.hypot("a", "b") / (height * width))
    tops = sums.groupBy("frame").agg(F.max("value").alias("top"))
    return sums.join(tops, "frame").select("frame", "row", "col", F.when(F.col("top") > 0, F.col("value") / F.col("top")).otherwise(F.col("value")).alias("value"))


def windowed(grid: DataFrame, height: int, width: int, window: str = "hann") -> tuple[DataFrame, float]:
    """The grid less its mean, times a separable window, and the window's summed squares."""
    means = grid.groupBy("frame").agg(F.avg("value").alias("__mean"))
    w = window_value(F.col("row"), height, window) * window_value(F.col("col"), width, window)
    line = lambda n: sum(_window_number(i, n, window) ** 2 for i in range(n))
    power = line(height) * line(width)
    if power <= 0:
        raise ValueError("the window has no power over this rectangle")
    return grid.join(means, "frame").withColumn("value", (F.col("value") - F.col("__mean")) * w).drop("__mean"), power


def _window_number(i: int, n: int, name: str) -> float:
    return 1.0 if n == 1 or name == "none" else sum(c * math.cos(2 * math.pi * k * i / (n - 1)) for k, c in enumerate(WINDOWS[name]))


def band_spectrum(grid: DataFrame, height: int, width: int, band: tuple[float, float], window: str = "hann") -> DataFrame:
    """``frame, fr, fc, re, im, intensity, radial, eligible`` of the windowed grid, intensity over the window's power.

    Frequencies are in cycles a pixel; eligible ones lie in the closed band, zero never."""
    if not 0 <= band[0] < band[1]:
        raise ValueError(f"a band has increasing bounds from zero on: {band}")
    data, power = windowed(grid, height, width, window)
    spec = spectrum(data, height, width)
    radial = F.hypot(F.col("fr") / float(height), F.col("fc") / float(width))
    out = spec.withColumn("intensity", (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / power).withColumn("radial", radial)
    return out.withColumn("eligible", (F.col("radial") >= band[0]) & (F.col("radial") <= band[1]) & (F.col("radial") > 0))


def band_metrics(spec: DataFrame, low: float) -> DataFrame:
    """Band maximum, mean and their ratio, and the shares of power in and below the band (null without power)."""
    ok, i, r = F.col("eligible"), F.col("intensity"), F.col("radial")
    s = spec.groupBy("frame").agg(F.max(F.when(ok, i)).alias("mx"), F.avg(F.when(ok, i)).alias("av"), F.sum(F.when(r > 0, i)).alias("all"), F.sum(F.when((r > 0) & (r < low), i).otherwise(0.0)).alias("lo"), F.sum(F.when(ok, i).otherwise(0.0)).alias("bd"))
    part = lambda c: F.when(F.col("all") > 0, F.col(c) / F.col("all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return s.select("frame", zero("mx").alias("eligible_max"), zero("av").alias("eligible_mean"), F.when(F.col("av") > 0, F.col("mx") / F.col("av")).otherwise(0.0).alias("metric"), part("lo").alias("low_frequency_power_fraction"), part("bd").alias("eligible_power_fraction"))


def peak_pairs(spec: DataFrame, height: int, width: int, k: int, digits: int = 6) -> DataFrame:
    """The ``k`` strongest conjugate pairs of the band; a bin that is its own conjugate stands alone.

    The pair is named by its member that comes first by row and column; pairs without power are left out; ties
    (after rounding) go by row and column."""
    wrap = lambda f, n: F.pmod(-F.col(f) + n // 2, F.lit(n)) - n // 2
    own, twin = F.struct(F.col("fr").alias("fr"), F.col("fc").alias("fc")), F.struct(wrap("fr", height).alias("fr"), wrap("fc", width).alias("fc"))
    pairs = spec.where("eligible").groupBy("frame", F.least(own, twin).alias("first")).agg(F.sum("intensity").alias("total_power"), F.avg("intensity").alias("mean_intensity"), F.count("*").alias("member_count"))
    rank = F.row_number().over(Window.partitionBy("frame").orderBy(F.round("total_power", digits).desc(), "first"))
    radial = F.hypot(F.col("first.fr") / float(height), F.col("first.fc") / float(width))
    return pairs.where(F.col("total_power") > 0).withColumn("rank", rank).where(F.col("rank") <= k).select("frame", "rank", F.col("first.fr").alias("fr"), F.col("first.fc").alias("fc"), radial.alias("radial"), (1 / radial).alias("wavelength"), "mean_intensity", "total_power", "member_count")


def radial_profile(spec: DataFrame, height: int, width: int, bin_width: float | None = None) -> DataFrame:
    """Mean, total and count of intensity by annulus [i w, (i + 1) w), zero frequency excluded; every annulus."""
    w = bin_width or min(1 / height, 1 / width)
    top = math.hypot((height // 2) / height, (width // 2) / width)
    n = int(math.floor(top / w + 1e-9)) + 1
    some = spec.where(F.col("radial") > 0).groupBy("frame", F.floor(F.col("radial") / w + 1e-9).cast("int").alias("bin")).agg(F.avg("intensity").alias("mean_intensity"), F.sum("intensity").alias("total_power"), F.count("*").alias("n"))
    spine = spec.select("frame").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spine.join(some, ["frame", "bin"], "left").select("frame", "bin", ((F.col("bin") + 0.5) * w).alias("center"), "mean_intensity", F.coalesce("total_power", F.lit(0.0)).alias("total_power"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
