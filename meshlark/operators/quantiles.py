"""Exact quantiles of groups of any size, by distributed selection.

A group of up to ``BOUND`` values is sorted in one task.  In a larger one the places that a quantile lies between are closed
in on: values near the place (from a mergeable summary of what is left) cut the rest in parts, the parts are counted exactly,
and the one that holds the place goes on until it is small or all one value.  Only counts decide, so the summary's error
costs rounds and never the result."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.sources.settled import settled

#: Values of a group that one task holds.
BOUND = 1 << 20
#: Parts into which a summary cuts what is left.
_PARTS = 128


def _same(by: list[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return same


def _marked(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"__{c}" for c in by})


def select_ranks(values: DataFrame, by: list[str], ranks: DataFrame, bound: int = BOUND) -> DataFrame:
    """``by..., rank, x``: the value (of ``__x``) that has so many smaller ones, ties counted, before it in its group.

    ``ranks`` has ``by``, ``rank`` from 0 and ``n``, the group's number of values."""
    keys = [*by, "rank"]
    state = ranks.select(*by, "rank", F.lit(0).cast("long").alias("before"), F.col("n").alias("left"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    done = None
    while True:
        state = settled(state)
        ready = state.where((F.col("left") <= bound) | (F.col("low") == F.col("high")))
        inside = lambda s: values.join(_marked(s, by), _same(by) & F.col("__x").between(F.col("low"), F.col("high")))  # noqa: E731, B023
        order = Window.partitionBy(*keys).orderBy("__x")
        # what is all one value needs no rows
        near = inside(ready.where(F.col("low") < F.col("high"))).withColumn("__i", F.row_number().over(order) - 1).where(F.col("__i") == F.col("rank") - F.col("before"))
        found = near.select(*keys, F.col("__x").alias("x")).unionByName(ready.where(F.col("low") == F.col("high")).select(*keys, F.col("low").alias("x")))
        done = settled(found) if done is None else done.unionByName(settled(found))
        state = state.where((F.col("left") > bound) & (F.col("low") < F.col("high")))
        if state.isEmpty():
            return done
        cuts = F.percentile_approx("__x", F.array(*[F.lit(i / _PARTS) for i in range(1, _PARTS)]), F.lit(16 * _PARTS))
        summary = inside(state).groupBy(*keys).agg(F.first("before").alias("before"), F.first("left").alias("left"), F.first("low").alias("low"), F.first("high").alias("high"), cuts.alias("cuts"))
        place = F.floor((F.col("rank") - F.col("before")) / F.col("left") * _PARTS).cast("int")
        at = lambda i: F.get("cuts", F.greatest(F.lit(0), F.least(F.lit(_PARTS - 2), i)))
        summary = settled(summary.withColumn("a", at(place - 3)).withColumn("b", at(place + 2)).drop("cuts"))
        x, a, b = F.col("__x"), F.col("a"), F.col("b")
        parts = {"under": x < a, "at_a": x == a, "between": (x > a) & (x < b), "at_b": (x == b) & (a < b), "over": x > b}
        counted = inside(summary).groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("before", "a", "b")], *[F.count_if(p).alias(k) for k, p in parts.items()], *[f(F.when(parts[k], x)).alias(f"{k}_{n}") for k in ("under", "between", "over") for n, f in (("low", F.min), ("high", F.max))])
        ends = {k: (F.col(f"{k}_low"), F.col(f"{k}_high")) for k in ("under", "between", "over")} | {"at_a": (F.col("a"), F.col("a")), "at_b": (F.col("b"), F.col("b"))}
        taken, start = None, F.col("before")
        for k in parts:
            here = F.struct(start.alias("before"), F.col(k).alias("left"), ends[k][0].alias("low"), ends[k][1].alias("high"))
            mine = F.col("rank") < start + F.col(k)
            taken = F.when(mine, here) if taken is None else taken.when(mine, here)
            start = start + F.col(k)
        state = counted.select(*keys, taken.alias("t")).select(*keys, "t.*")


def grouped_quantiles(df: DataFrame, by: list[str], quantiles: Mapping[str, tuple[Column, float]], others: list[Column] | None = None, bound: int = BOUND) -> DataFrame:
    """``by``, the aggregates ``others``, and by name the exact quantile of a column at a probability.

    A quantile lies at p (n - 1) between sorted values, interpolated; nulls are not counted, and without values it is
    null.  Columns of values are read as doubles."""
    columns: dict[str, Column] = {}
    for c, _ in quantiles.values():
        if not any(c is d for d in columns.values()):
            columns[f"__v{len(columns)}"] = c
    wide = df.select("*", *[c.cast("double").alias(n) for n, c in columns.items()])
    name_of = {q: next(n for n, d in columns.items() if d is c) for q, (c, _) in quantiles.items()}
    totals = settled(wide.groupBy(*by).agg(*(others or []), *[F.count(n).alias(f"{n}n") for n in columns]))
    largest = totals.agg(*[F.max(f"{n}n").alias(n) for n in columns]).first()
    small = {n for n in columns if (largest[n] or 0) <= bound}
    out = totals
    if small:
        at_once = wide.groupBy(*by).agg(*[F.percentile(name_of[q], F.lit(p)).alias(q) for q, (_, p) in quantiles.items() if name_of[q] in small])
        out = _joined(out, at_once, by)
    for n in columns.keys() - small:
        values = wide.select(*by, F.col(n).alias("__x")).where(F.col("__x").isNotNull())
        own = {q: p for q, (_, p) in quantiles.items() if name_of[q] == n}
        place = {q: (F.col("n") - 1) * F.lit(p) for q, p in own.items()}
        some = totals.select(*by, F.col(f"{n}n").alias("n")).where(F.col("n") > 0)
        ranks = some.select(*by, "n", F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in place.values()])))).alias("rank"))
        found = select_ranks(values, by, ranks, bound)
        lists = _joined(some, found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("__at")), by)
        value = lambda x: F.try_element_at(F.col("__at"), F.floor(x)) * (1 - (x - F.floor(x))) + F.try_element_at(F.col("__at"), F.ceil(x)) * (x - F.floor(x))
        out = _joined(out, lists.select(*by, *[value(x).alias(q) for q, x in place.items()]), by)
    return out.drop(*[f"{n}n" for n in columns])


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return left.crossJoin(right)  # one row each
    return left.join(_marked(right, by), _same(by), "left").drop(*[f"__{c}" for c in by])
