"""Statistics by frame: summaries, row bins, tests, harmonic fits, false discovery rates and block bootstrap.

Missing is null throughout; values that are not finite take no part.  Rows are aggregated where they are; what is
joined back is one row a frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.functions.special import f_tail, t_tail
from meshlark.operators.quantiles import BOUND, grouped_quantiles
from meshlark.sources.settled import settled

EPS = 2.220446049250313e-16


def finite(x: str | Column) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_mean(value: str) -> Column:
    return F.avg(F.when(finite(value), F.col(value)))


def weighted_mean(value: str, weight: str) -> Column:
    ok = finite(value) & finite(weight) & (F.col(weight) > 0)
    return F.try_divide(F.sum(F.when(ok, F.col(value) * F.col(weight))), F.sum(F.when(ok, F.col(weight))))


def area_summary(areas: DataFrame, by: str = "frame", area: str = "area", bound: int = BOUND) -> DataFrame:
    """Smallest, median, mean and largest area of each frame."""
    a = F.col(area)
    others = [F.min(a).alias("area_min"), F.avg(a).alias("area_mean"), F.max(a).alias("area_max")]
    return grouped_quantiles(areas, [by], {"area_median": (a, 0.5)}, others, bound).select(by, "area_min", "area_median", "area_mean", "area_max")


def complex_summary(psi: DataFrame, n_fold: int, weight: str | None = None, by: str = "frame") -> DataFrame:
    """Mean, resultant, orientation and phase coherence of complex values (re, im), optionally weighted.

    A value counts if both parts and its weight are finite and the weight is positive; an orientation needs a
    resultant above machine precision."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    ok = finite("re") & finite("im") & finite(w) & (w > 0)
    sums = psi.groupBy(by).agg(
        *[F.sum(F.when(ok, w * F.col(c))).alias(c) for c in ("re", "im")], F.sum(F.when(ok, w)).alias("w"), F.sum(F.when(ok, w * F.hypot("re", "im"))).alias("m")
    )
    re, im = F.try_divide("re", "w"), F.try_divide("im", "w")
    turn = 2 * math.pi / n_fold
    angle = F.when(F.hypot(re, im) > EPS, F.pmod(F.atan2(im, re) / n_fold, F.lit(turn)))
    return sums.select(
        by,
        re.alias("mean_real"),
        im.alias("mean_imag"),
        F.hypot(re, im).alias("resultant_magnitude"),
        angle.alias("orientation_radians"),
        F.degrees(angle).alias("orientation_degrees"),
        F.when(F.col("m") > 0, F.hypot("re", "im") / F.col("m")).alias("phase_coherence"),
    )


def row_bins(regions: DataFrame, height: float, bin_size: float, value: str = "value", by: str = "frame") -> DataFrame:
    """Mean and count by half-open row bins from 0; every bin of every frame, empty ones with a null mean."""
    n = math.ceil(height / bin_size)
    ok = regions.where(finite("row") & finite(value))
    binned = ok.withColumn("bin", F.floor(F.col("row") / bin_size).cast("int")).where(F.col("bin").between(0, n - 1))
    found = binned.groupBy(by, "bin").agg(F.avg(F.abs(value)).alias("bin_mean"), F.count("*").alias("bin_count"))
    spine = regions.select(by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    center = (F.col("bin") + 0.5) * bin_size
    return spine.join(found, [by, "bin"], "left").select(by, "bin", center.alias("bin_center"), "bin_mean", F.coalesce("bin_count", F.lit(0)).cast("long").alias("bin_count"))


def _constant(value: Column, first: Column) -> Column:
    """Whether all values are as close to the first as makes no difference."""
    return F.bool_and(F.abs(value - first) <= 1e-8 + 1e-5 * F.abs(first))


def pearson(regions: DataFrame, value: str = "value", by: str = "frame", key: str = "region_id", periodic: bool = False) -> DataFrame:
    """Correlation of row and value with its p-value: null for wrapping rows, fewer than three, or constant data."""
    empty = F.lit(None).cast("double")
    if periodic:
        return regions.select(by).distinct().select(by, empty.alias("correlation"), empty.alias("correlation_p_value"))
    ok = regions.where(finite("row") & finite(value)).withColumn("v", F.abs(value))
    first = ok.groupBy(by).agg(F.min_by("row", key).alias("row0"), F.min_by("v", key).alias("v0"))
    found = ok.join(first, by).groupBy(by).agg(F.count("*").alias("n"), F.corr("row", "v").alias("r"), _constant(F.col("row"), F.col("row0")).alias("flat"), _constant(F.col("v"), F.col("v0")).alias("same"))
    able = (F.col("n") >= 3) & ~F.col("flat") & ~F.col("same")
    r, df = F.col("r"), (F.col("n") - 2).cast("double")
    p = F.when(F.abs(r) >= 1, F.lit(0.0)).when(df > 0, t_tail(r * F.sqrt(df / (1 - r * r)), df))
    everyone = regions.select(by).distinct()
    return everyone.join(found.select(by, F.when(able, r).alias("correlation"), F.when(able, p).alias("correlation_p_value")), by, "left")


def anova(regions: DataFrame, bin_size: float, value: str = "value", by: str = "frame", key: str = "region_id") -> DataFrame:
    """One-way analysis of variance over row bins with two members or more; null without two such or if all is constant.

    Groups are centred on their means before squares are taken."""
    ok = regions.where(finite("row") & finite(value)).select(by, key, F.floor(F.col("row") / bin_size).alias("bin"), F.abs(value).alias("v"))
    groups = ok.groupBy(by, "bin").agg(F.count("*").alias("m"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.min(F.struct(key, "v")).alias("first"), F.min("v").alias("low"), F.max("v").alias("high")).where(F.col("m") >= 2)
    whole = groups.groupBy(by).agg(
        F.sum("m").alias("n"),
        F.count("*").alias("k"),
        (F.sum(F.col("m") * F.col("mean")) / F.sum("m")).alias("grand"),
        F.sum(F.col("m") * F.col("var")).alias("within"),
        F.min(F.struct("bin", F.col("first")["v"].alias("v"))).alias("f"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    between = groups.join(whole.select(by, "grand"), by).groupBy(by).agg(F.sum(F.col("m") * F.pow(F.col("mean") - F.col("grand"), F.lit(2))).alias("between"))
    v0 = F.col("f")["v"]
    slack = 1e-8 + 1e-5 * F.abs(v0)
    constant = (F.abs(F.col("low") - v0) <= slack) & (F.abs(F.col("high") - v0) <= slack)
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    f = F.when((F.col("k") >= 2) & ~constant & (F.col("within") > 0), (F.col("between") / d1) / (F.col("within") / d2))
    # no spread within groups: F is unbounded, given as missing with p = 0
    p = F.when(f.isNotNull(), f_tail(f, d1, d2)).when((F.col("k") >= 2) & ~constant, F.lit(0.0))
    found = whole.join(between, by).select(by, f.alias("anova_f_statistic"), p.alias("anova_p_value"))
    return regions.select(by).distinct().join(found, by, "left")


def _harmonic_sums(phase: Column, y: Column) -> list[Column]:
    c, s = F.cos(phase), F.sin(phase)
    terms = {"n": F.lit(1.0), "c": c, "s": s, "cc": c * c, "cs": c * s, "ss": s * s, "y": y, "yc": y * c, "ys": y * s}
    return [F.sum(v).alias(f"s_{k}") for k, v in terms.items()]


def harmonic(regions: DataFrame, height: float, value: str = "value", by: str = "frame", key: str = "region_id", basis: str = "value") -> DataFrame:
    """First harmonic b0 + b1 cos + b2 sin of values along wrapping rows, with its nested F test.

    Normal equations from sums of centred values, residuals in a second pass.  Fewer than four values, constant
    values or rows that don't determine the fit give nulls; an exact fit has no F and p = 0."""
    ok = regions.where(finite("row") & finite(value)).select(by, key, (F.col("row") * (2 * math.pi / height)).alias("phase"), F.abs(value).alias("v"))
    means = ok.groupBy(by).agg(F.avg("v").alias("mean"), F.min_by("v", key).alias("v0"))
    centred = ok.join(means, by).withColumn("y", F.col("v") - F.col("mean"))
    sums = centred.groupBy(by).agg(*_harmonic_sums(F.col("phase"), F.col("y")), _constant(F.col("v"), F.col("v0")).alias("same"))
    s = {k: F.col(f"s_{k}") for k in ("n", "c", "s", "cc", "cs", "ss", "y", "yc", "ys")}
    # eliminate the constant, then a 2 x 2 system
    a, b, d = s["cc"] - s["c"] * s["c"] / s["n"], s["cs"] - s["c"] * s["s"] / s["n"], s["ss"] - s["s"] * s["s"] / s["n"]
    p, q = s["yc"] - s["c"] * s["y"] / s["n"], s["ys"] - s["s"] * s["y"] / s["n"]
    det = a * d - b * b
    able = (s["n"] >= 4) & ~F.col("same") & (det > 1e-12 * s["n"] * s["n"])
    fit = sums.select(by, s["n"].alias("n"), F.when(able, (p * d - q * b) / det).alias("b1"), F.when(able, (q * a - p * b) / det).alias("b2"), (s["c"] / s["n"]).alias("mc"), (s["s"] / s["n"]).alias("ms"), (s["y"] / s["n"]).alias("my"))
    fitted = F.col("my") + F.col("b1") * (F.cos("phase") - F.col("mc")) + F.col("b2") * (F.sin("phase") - F.col("ms"))
    left = centred.join(fit, by).groupBy(by).agg(F.first("n").alias("n"), F.first("b1").alias("b1"), F.first("b2").alias("b2"), F.sum(F.pow(F.col("y") - fitted, F.lit(2))).alias("rss"), F.sum(F.col("y") * F.col("y")).alias("tss"))
    able = F.col("b1").isNotNull() & (F.col("tss") > 0)
    exact = F.col("rss") <= EPS * F.greatest(F.col("tss"), F.lit(1.0))
    gain = F.greatest(F.lit(0.0), F.col("tss") - F.col("rss")) / 2
    df = F.col("n") - 3
    f = F.when(able & ~exact, gain / (F.col("rss") / df))
    # with two degrees of freedom in the numerator the tail has a closed form
    p = F.when(able & exact, F.when(gain > 0, F.lit(0.0)).otherwise(F.lit(1.0))).when(able, F.pow(1 + 2 * f / df, -df / 2))
    peak = F.pmod(F.atan2("b2", "b1"), F.lit(2 * math.pi))
    out = left.select(
        by,
        F.lit(basis).alias("basis"),
        F.when(able, F.col("b1")).alias("cosine_coefficient"),
        F.when(able, F.col("b2")).alias("sine_coefficient"),
        F.when(able, F.hypot("b1", "b2")).alias("amplitude"),
        F.when(able, peak * (height / (2 * math.pi))).alias("peak_row"),
        F.when(able, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("rss") / F.col("tss")))).alias("r_squared"),
        f.alias("f_statistic"),
        p.alias("p_value"),
    )
    return regions.select(by).distinct().join(out, by, "left").withColumn("basis", F.lit(basis))


def benjamini_hochberg(tests: DataFrame, p: str, q: str, family: list[str] | None = None, alone: int = 1 << 20, ranges: int = 64) -> DataFrame:
    """Adds q-values: the least p * m / rank from each rank on, at most 1; missing p-values stay missing, uncounted.

    Up to ``alone`` tests, a family is one task.  More are cut into ``ranges`` of p-values: ranks and the least value from a rank on
    are made within a range, from one row for each distinct p-value, and what the ranges before and behind it add is one
    row a range."""
    valid = F.col(p).isNotNull() & F.col(p).between(0, 1)
    tests = settled(tests)
    if tests.count() > alone:
        return _adjusted_by_ranges(tests, valid, p, q, family or [], ranges)
    part = [valid, *[F.col(c) for c in family or []]]
    order = Window.partitionBy(*part).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*part))
    tail = Window.partitionBy(*part).orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = tests.withColumn("__rank", F.row_number().over(order)).withColumn("__m", m)
    value = F.when(valid, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(tail)))
    return ranked.withColumn(q, value).drop("__rank", "__m")


def _adjusted_by_ranges(tests: DataFrame, valid: Column, p: str, q: str, family: list[str], ranges: int) -> DataFrame:
    # tests with equal p-values share the last of their ranks
    of = F.struct(F.lit(0), *[F.col(c) for c in family])
    counted = settled(tests.where(valid).groupBy(of.alias("__f"), F.col(p).alias("__p")).agg(F.count("*").alias("__c")))
    ends = counted.groupBy("__f").agg(F.percentile_approx("__p", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(16 * ranges)).alias("__ends"))
    placed = counted.join(ends, "__f").withColumn("__b", F.size(F.filter("__ends", lambda e: e < F.col("__p")))).drop("__ends")
    inside = Window.partitionBy("__f", "__b")
    upward = inside.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    placed = settled(placed.withColumn("__rank", F.sum("__c").over(upward)))
    over = Window.partitionBy("__f")
    sizes = placed.groupBy("__f", "__b").agg(F.sum("__c").alias("__n"))
    sizes = sizes.select("__f", "__b", F.coalesce(F.sum("__n").over(over.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(over).alias("__m"))
    valued = placed.join(sizes, ["__f", "__b"]).withColumn("__v", F.col("__p") * F.col("__m") / (F.col("__before") + F.col("__rank")))
    valued = settled(valued.withColumn("__v", F.min("__v").over(inside.orderBy(F.col("__p").desc()).rowsBetween(Window.unboundedPreceding, 0))).select("__f", "__b", "__p", "__v"))
    least = valued.groupBy("__f", "__b").agg(F.min("__v").alias("__l"))
    behind = least.select("__f", "__b", F.min("__l").over(over.orderBy("__b").rowsBetween(1, Window.unboundedFollowing)).alias("__l"))
    adjusted = valued.join(behind, ["__f", "__b"]).select("__f", "__p", F.least(F.lit(1.0), "__v", "__l").alias("__q"))
    joined = tests.join(adjusted, of.eqNullSafe(F.col("__f")) & (F.col(p) == F.col("__p")), "left")
    return joined.withColumn(q, F.col("__q")).drop("__f", "__p", "__q")


def conclusions(tests: DataFrame, alpha: float = 0.05, periodic: bool = False) -> DataFrame:
    """What the tests support, in words; q-values go before p-values."""

    def said(q: str, p: str, none: str, yes: str, no: str) -> Column:
        value = F.coalesce(F.col(q), F.col(p))
        label = F.when(F.col(q).isNotNull(), "BH-adjusted q-value").otherwise("p-value")
        return F.when(value.isNull(), F.lit(none)).when(value <= alpha, F.concat(F.lit(f"{yes} ("), label, F.lit(f" ≤ {alpha:g})."))).otherwise(F.concat(F.lit(f"{no} ("), label, F.lit(f" > {alpha:g}).")))

    skipped = "row coordinate is periodic; see harmonic association instead" if periodic else "insufficient or constant data"
    return tests.withColumn("pearson_conclusion", said("correlation_q_value_bh", "correlation_p_value", f"Pearson test not performed ({skipped}).", "Evidence of a linear association", "Failed to reject no linear association")).withColumn(
        "anova_conclusion",
        said("anova_q_value_bh", "anova_p_value", "ANOVA not performed (insufficient or constant groups).", "Evidence that at least one row-bin mean differs", "Failed to reject equality of row-bin means"),
    )


_TERMS = ("n", "mag", "area", "area_mag", "re", "im", "c", "s", "cc", "cs", "ss", "yc", "ys", "yy")


def _metrics(periodic: bool) -> dict[str, Column]:
    """Metrics from sums over blocks; null where they are not defined."""
    n, mag, area, area_mag, re, im, c, s, cc, cs, ss, yc, ys, yy = (F.col(t) for t in _TERMS)
    out = {"cell_mean_psi_magnitude": F.try_divide(mag, n), "area_weighted_mean_psi_magnitude": F.try_divide(area_mag, area), "phase_coherence_cell": F.when(mag > 0, F.hypot(re, im) / mag)}
    if periodic:
        a, b, d = cc - c * c / n, cs - c * s / n, ss - s * s / n
        p, q, t = yc - c * mag / n, ys - s * mag / n, yy - mag * mag / n
        det = a * d - b * b
        explained = F.try_divide(p * (p * d - q * b) + q * (q * a - p * b), det)
        able = (n >= 4) & (t > 1e-10 * yy) & (det > 1e-12 * n * n)
        out["harmonic_r_squared_raw"] = F.when(able, F.greatest(F.lit(0.0), F.least(F.lit(1.0), explained / t)))
    return {k: F.when(finite(v), v) for k, v in out.items()}


def drawn(n: Column, *parts: Column | int) -> Column:
    """A number from 0 to n - 1 that ``parts`` alone decide: 60 bits of the digest of all of them, modulo n.

    So a draw is the same in every run and on every machine, whatever else is drawn."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), n)


def block_bootstrap(regions: DataFrame, height: float, block: int = 100, replicates: int = 1000, level: float = 0.95, seed: int = 0, periodic: bool = True, by: str = "frame") -> DataFrame:
    """Confidence intervals from resampled spatial blocks, for regions (row, col, re, im, area).

    All metrics are functions of sums, so regions are summed by block first.  A replicate draws as many blocks as a frame has,
    each draw from seed, frame, replicate and draw; draws are joined with the blocks and summed.  Undefined replicates are
    dropped; a frame without values has no rows."""
    mag = F.hypot("re", "im")
    phase = F.col("row") * (2 * math.pi / height)
    c, s = F.cos(phase), F.sin(phase)
    terms = [F.lit(1.0), mag, F.col("area"), F.col("area") * mag, F.col("re"), F.col("im"), c, s, c * c, c * s, s * s, mag * c, mag * s, mag * mag]
    sums = lambda: [F.sum(t).alias(t) for t in _TERMS]
    place = ["block_row", "block_col"]
    valued = regions.where(finite("re") & finite("im")).select(F.col(by).cast("long").alias("frame"), F.floor(F.col("row") / block).alias("block_row"), F.floor(F.col("col") / block).alias("block_col"), *[t.cast("double").alias(n) for t, n in zip(terms, _TERMS)])
    blocks = valued.groupBy("frame", *place).agg(*sums())
    blocks = settled(blocks.withColumn("block", F.row_number().over(Window.partitionBy("frame").orderBy(*place)) - 1))
    frames = blocks.groupBy("frame").agg(F.count("*").alias("occupied_blocks"))
    each = frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = each.select("*", F.explode(F.sequence(F.lit(0), (F.col("occupied_blocks") - 1).cast("int"))).alias("draw"))
    draws = draws.select("frame", "replicate", drawn(F.col("occupied_blocks"), seed, F.col("frame"), F.col("replicate"), F.col("draw")).alias("block"))
    named = lambda df, name: df.select("frame", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias(name)) for k, v in _metrics(periodic).items()])).alias("m")).select("frame", "m.*")
    again = named(draws.join(blocks, ["frame", "block"]).groupBy("frame", "replicate").agg(*sums()), "value")
    alpha = (1 - level) / 2
    ends = again.groupBy("frame", "metric").agg(F.percentile("value", F.lit(alpha)).alias("confidence_low"), F.percentile("value", F.lit(1 - alpha)).alias("confidence_high"))
    whole = named(blocks.groupBy("frame").agg(*sums()), "estimate")
    out = whole.join(ends, ["frame", "metric"], "left").join(frames, "frame")
    return out.select("frame", "metric", "estimate", "confidence_low", "confidence_high", F.col("occupied_blocks").cast("int").alias("occupied_blocks"), F.lit(replicates).alias("replicates"))
