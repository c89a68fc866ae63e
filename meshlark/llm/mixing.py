"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import text_or_empty, word_count

def _seeded(seed: str, doc_id: str, text: str) -> Column:
    """A hash of the id, or of the text of a document without one."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("#"), F.md5(text_or_empty(text))))))


def _slice_digits(partitions: int) -> int:
    """Hexadecimal digits that tell a source's slices apart: at least 16 slices a shuffle partition, and 4096."""
    return max(3, -(-(16 * partitions - 1).bit_length() // 4))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Targets per source from (source, source_size).

    Water-filling: with level L, a source gets ``min(cap, L * weight)``, and L is such that the targets add up to
    ``share`` of all sizes.  Sources are taken by ``cap / weight``; before each, those already passed stay at their
    caps and the rest is shared by weight, which gives the level that holds if this source is the first below its cap.
    From the first such source on these levels only fall, so the largest of them is the one that holds.
    One row a source goes through one sort; documents never do."""
    # one row a source: rank by code point (binary order of UTF-8), null last
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") - 1) % len(weights) + 1)
    everything = Window.partitionBy()
    passed = Window.orderBy(F.col("ratio"), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("spent", F.coalesce(F.sum("cap").over(passed), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(passed), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("spent")) / (F.col("all_weight") - F.col("gone")))
        .withColumn("holds", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    )
    filled = level.withColumn("final", F.max("holds").over(everything))
    target = F.when(F.col("final").isNull() | (F.col("ratio") < F.col("final")), F.col("cap")).otherwise(F.col("final") * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2,
    seed: str = "mix",
    keep: Sequence[str] = (),
) -> DataFrame:
    """How many words of each document a mix of sources takes.

    Returns ``doc_id, source, size, source_size, target, taken`` and the columns of ``keep`` (under their names with
    ``kept_`` before), one row for each row of ``docs``.  Size is the
    number of words (null or empty text: 0, taken 0).  Sources in code-point order (null last, a source of its own)
    weigh ``weights``, repeating; targets come from :func:`source_targets`.  A source's target is whole repetitions
    of all its documents plus a remainder: documents in the order of a seeded hash are repeated once more until the
    remainder is reached, the last of them in part, so a source's taken words are its target rounded down.  Ties of
    the hash (repeated rows) are taken in the order of id and size; equal rows are exchangeable.  An empty table
    gives an empty result.

    The remainder is located in two steps, so that no source is ever sorted in one task: sizes are summed by
    (source, hash slice), and only inside a slice are documents put in order.  There are more slices where the session
    has more shuffle partitions; they are stretches of one order, so the result doesn't depend on their number.
    Documents without an id are in the order of a hash of their text.  Columns not in ``keep`` are passed over."""
    digits = _slice_digits(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    h = _seeded(seed, doc_id, text)
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(text_or_empty(text)).alias("size"),
        F.conv(F.substring(h, 1, digits), 16, 10).cast("long").alias("slice"),
        h.alias("h"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, max_epochs)
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        slices.withColumn("before", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
        .alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select(F.col("s.source").alias("p_source"), F.col("slice").alias("p_slice"), "before", "source_size", "target")
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("left", F.floor("target") - F.col("whole") * F.col("source_size") - F.col("before"))
    )
    inside = Window.partitionBy("source", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(F.sum("size").over(inside), F.lit(0))))
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("slice") == F.col("p_slice")))
        .withColumn("extra", extra)
        .select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), *[f"kept_{c}" for c in keep])
    )
