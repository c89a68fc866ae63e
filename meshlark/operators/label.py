"""Connected components of foreground pixels, their filters and quality figures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators.quantiles import BOUND, grouped_quantiles
from meshlark.sources.settled import settled

#: Rows that are labelled in one task.
BAND = 256
#: Links of components over edges that one task joins.
ALONE = 1 << 17


def row_runs(pixels: DataFrame) -> DataFrame:
    """``frame, row, first, last``: foreground pixels of a row that stand next to each other, as runs."""
    by = Window.partitionBy("frame", "row").orderBy("col")
    islands = pixels.select("frame", "row", "col").withColumn("island", F.col("col") - F.row_number().over(by))
    return islands.groupBy("frame", "row", "island").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("island")


def _meeting(first_a: np.ndarray, last_a: np.ndarray, first_b: np.ndarray, last_b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Indexes of runs of two rows (each in order) that touch, corners included."""
    a = b = 0
    while a < len(first_a) and b < len(first_b):
        if first_a[a] <= last_b[b] + 1 and first_b[b] <= last_a[a] + 1:
            yield a, b
        if last_a[a] < last_b[b]:
            a += 1
        else:
            b += 1


def _join_runs(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each run (sorted by row and column) the index of the first run of its component."""
    parent = list(range(len(row)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(row)]
    for k in range(len(starts) - 1):
        if row[starts[k + 1]] == row[starts[k]] + 1:
            here, below = slice(starts[k], ends[k]), slice(starts[k + 1], ends[k + 1])
            for a, b in _meeting(first[here], last[here], first[below], last[below]):
                x, y = root(int(starts[k]) + a), root(int(starts[k + 1]) + b)
                parent[max(x, y)] = min(x, y)
    return np.array([root(x) for x in range(len(row))], np.int64)


def components(pixels: DataFrame, height: int | None = None, band: int = BAND, alone: int = ALONE) -> DataFrame:
    """``frame, row, first, last, label, wrapped``: labelled runs of foreground pixels (frame, row, col).

    Pixels touch along sides and corners; with ``height`` the top and bottom rows touch too.  Labels count from 1 in
    the order of first pixels, row by row.

    Bands of ``band`` rows are labelled apart, a task a band; then only the components that touch over the edges of bands, or
    over the seam, are joined, as a graph.  So a frame of any height is many tasks, and a task has a band's runs."""
    kinds = dict(pixels.dtypes)
    # a component is named by its first pixel
    runs = row_runs(pixels).select("frame", "row", "first", "last").withColumn("band", F.floor(F.col("row") / band))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "first"]).reset_index(drop=True)
        at = _join_runs(pdf["row"].to_numpy(), pdf["first"].to_numpy(), pdf["last"].to_numpy())
        return pdf.assign(root_row=pdf["row"].to_numpy()[at], root_col=pdf["first"].to_numpy()[at])

    shape = f"frame {kinds['frame']}, row {kinds['row']}, first {kinds['col']}, last {kinds['col']}, band long, root_row {kinds['row']}, root_col {kinds['col']}"
    local = settled(runs.groupBy("frame", "band").applyInPandas(within, shape))

    # the last row of a band meets the first of the next; the seam is the edge below the bottom row
    low = F.col("row") % band == band - 1
    high = F.col("row") % band == 0
    edge = F.when(low, F.col("band")), F.when(high & (F.col("row") > 0), F.col("band") - 1)
    if height is not None and height > 1:
        edge = F.when(F.col("row") == height - 1, F.lit(-1)).when(low, F.col("band")), F.when(F.col("row") == 0, F.lit(-1)).when(high, F.col("band") - 1)
    sides = F.array(*[F.struct(e.cast("long").alias("edge"), F.lit(bool(k)).alias("below")) for k, e in enumerate(edge)])
    borders = local.withColumn("side", F.explode(F.filter(sides, lambda x: x["edge"].isNotNull()))).select("frame", "first", "last", "root_row", "root_col", "side.*")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        a, b = pdf[~pdf["below"]], pdf[pdf["below"]]
        met = np.array([*_meeting(a["first"].to_numpy(), a["last"].to_numpy(), b["first"].to_numpy(), b["last"].to_numpy())], np.int64).reshape(-1, 2)
        a, b = a.iloc[met[:, 0]], b.iloc[met[:, 1]]
        made = pd.DataFrame({"frame": a["frame"].to_numpy(), "edge": a["edge"].to_numpy(), "row_a": a["root_row"].to_numpy(), "col_a": a["root_col"].to_numpy(), "row_b": b["root_row"].to_numpy(), "col_b": b["root_col"].to_numpy()})
        return made.drop_duplicates()

    links = borders.groupBy("frame", "edge").applyInPandas(across, f"frame {kinds['frame']}, edge long, row_a {kinds['row']}, col_a {kinds['col']}, row_b {kinds['row']}, col_b {kinds['col']}")
    node = lambda x: F.struct("frame", F.col(f"row_{x}").alias("row"), F.col(f"col_{x}").alias("col"))
    links = settled(links.select("edge", node("a").alias("a"), node("b").alias("b")))
    roots = component_roots(links.select("a", "b"), alone)
    named = local.withColumn("own", F.struct("frame", F.col("root_row").alias("row"), F.col("root_col").alias("col")))
    named = named.join(roots, F.col("own") == F.col("node"), "left").withColumn("root", F.coalesce("root", "own"))
    seam = links.where(F.col("edge") == -1).select(F.col("a").alias("node")).join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), F.lit(True).alias("wrapped")).distinct()
    first = named.where(F.col("own") == F.col("root")).select("root", "band").distinct()
    labels = first.withColumn("frame", F.col("root.frame")).groupBy("frame", "root").agg(F.min("band").alias("band"))
    labels = numbered(labels, "frame", "band", F.struct(F.col("root.row"), F.col("root.col")), "label").select("root", "label").join(seam, "root", "left")
    return named.join(labels, "root").select("frame", "row", "first", "last", F.col("label").cast("int").alias("label"), F.coalesce("wrapped", F.lit(False)).alias("wrapped"))


def _roots_of(pdf: pd.DataFrame) -> pd.DataFrame:
    parent: dict[tuple, tuple] = {}

    def root(x: tuple) -> tuple:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    names = list(pdf["a"].iloc[0])
    for a, b in zip(pdf["a"], pdf["b"]):
        x, y = root(tuple(a[n] for n in names)), root(tuple(b[n] for n in names))
        parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return pd.DataFrame({"node": [dict(zip(names, x)) for x in nodes], "root": [dict(zip(names, root(x))) for x in nodes]})


def component_roots(links: DataFrame, alone: int = ALONE) -> DataFrame:
    """``node, root`` of every node of a graph (a, b): the least node that can be reached.

    Each round a node's neighbours are joined to the least of them, first the larger ones, then the smaller ones, until all
    point to their root; the rounds grow with the logarithm of a component.  Up to ``alone`` links are one task instead.  Nothing
    but a count is on the driver."""
    least, most = F.least("a", "b"), F.greatest("a", "b")
    state = settled(links.select(most.alias("a"), least.alias("b")).where(F.col("a") != F.col("b")).distinct())
    kind = state.schema["a"].dataType.simpleString()
    if state.count() <= alone:
        return state.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_roots_of, f"node {kind}, root {kind}")
    while not state.isEmpty():
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        reached = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(reached, F.col("a") == F.col("node")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        below = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        small = large.join(below, F.col("a") == F.col("node"))
        after = settled(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(below.select(F.col("node").alias("a"), F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct())
        if after.count() == state.count() and after.exceptAll(state).isEmpty():
            break
        state = after
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def numbered(rows: DataFrame, by: str, part: str, order: Column, name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... along ``order`` within ``by``, where ``part`` rises with ``order``.

    Rows are numbered within their part, and parts by their counts, so no task has all rows of a ``by``."""
    before = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(by, part).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = rows.withColumn("__i", F.row_number().over(Window.partitionBy(by, part).orderBy(order)))
    same = F.col(by).eqNullSafe(F.col("__by")) & F.col(part).eqNullSafe(F.col("__part"))
    joined = inside.join(counts.withColumnsRenamed({by: "__by", part: "__part"}), same)
    return joined.withColumn(name, F.col("__before") + F.col("__i")).drop("__by", "__part", "__i", "__before")


def label_pixels(runs: DataFrame) -> DataFrame:
    """``frame, row, col, label``."""
    return runs.select("frame", "row", F.explode(F.sequence("first", "last")).alias("col"), "label")


def regions(runs: DataFrame, height: int, width: int, periodic: bool) -> DataFrame:
    """``frame, label, area, row, col, border``: sizes and centroids of components, and whether they touch a border.

    A component across the seam is unrolled before its rows are averaged; left and right are always borders, top and
    bottom only if rows don't wrap."""
    n = F.col("last") - F.col("first") + 1
    r = F.when(F.col("wrapped") & (F.col("row") >= height / 2), F.col("row") - height).otherwise(F.col("row"))
    edge: Column = (F.col("first") == 0) | (F.col("last") == width - 1)
    if not periodic:
        edge = edge | (F.col("row") == 0) | (F.col("row") == height - 1)
    sums = runs.groupBy("frame", "label").agg(F.sum(n).alias("area"), F.sum(n * r).alias("sr"), F.sum(n * (F.col("first") + F.col("last")) / 2).alias("sc"), F.bool_or(edge).alias("border"))
    return sums.select("frame", "label", "area", F.pmod(F.col("sr") / F.col("area"), F.lit(float(height))).alias("row"), (F.col("sc") / F.col("area")).alias("col"), "border")


def filter_regions(found: DataFrame, min_area: float | None = None, max_area: float | None = None, exclude_border: bool = False) -> DataFrame:
    """Adds the rejections, ``kept`` and ``new_label`` (kept ones counted in the old order; null if rejected).

    Bounds are inclusive.  Without any filter labels stay."""
    no = F.lit(False)
    small = F.col("area") < min_area if min_area is not None else no
    large = F.col("area") > max_area if max_area is not None else no
    border = F.col("border") if exclude_border else no
    out = found.withColumns({"rejected_min": small, "rejected_max": large, "rejected_border": border}).withColumn("kept", ~(F.col("rejected_min") | F.col("rejected_max") | F.col("rejected_border")))
    if min_area is None and max_area is None and not exclude_border:
        return out.withColumn("new_label", F.col("label"))
    order = Window.partitionBy("frame", "kept").orderBy("label")
    return out.withColumn("new_label", F.when(F.col("kept"), F.row_number().over(order)))


def quality(filtered: DataFrame, bound: int = BOUND) -> DataFrame:
    """Counts and area summaries of raw and retained components, one row a frame."""
    raw, kept = F.col("area"), F.when(F.col("kept"), F.col("area"))
    ends = lambda a, of: [F.min(a).alias(f"{of}_area_min"), F.avg(a).alias(f"{of}_area_mean"), F.max(a).alias(f"{of}_area_max")]
    counts = [
        F.sum("area").alias("raw_foreground_pixels"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("retained_foreground_pixels"),
        F.count("*").alias("raw_component_count"),
        F.count_if("kept").alias("retained_component_count"),
        F.count_if(~F.col("kept")).alias("rejected_any_count"),
        F.count_if("rejected_min").alias("rejected_min_area_count"),
        F.count_if("rejected_max").alias("rejected_max_area_count"),
        F.count_if("rejected_border").alias("rejected_border_count"),
    ]
    found = grouped_quantiles(filtered, ["frame"], {"raw_area_median": (raw, 0.5), "retained_area_median": (kept, 0.5)}, [*counts, *ends(raw, "raw"), *ends(kept, "retained")], bound)
    areas = [f"{of}_area_{x}" for of in ("raw", "retained") for x in ("min", "median", "mean", "max")]
    return found.select("frame", *[c for c in found.columns if c != "frame" and c not in areas], *areas)


def value_map(pixels: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Each labelled pixel with its region's value (null if it has none); background is absent."""
    return pixels.join(values.select("frame", "label", value), ["frame", "label"], "left").select("frame", "row", "col", "label", value)
