"""Spans of regular expressions in texts, with code-point positions, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import cut_by, text_or_empty

#: What tells rows of documents apart: the id, a hash of id and text, and a number among rows that are equal in both.
ROW = ["doc_id", "row_key", "row_copy"]


@dataclass(frozen=True)
class Kind:
    """Leftmost non-overlapping matches of ``pattern`` that pass ``keep``; others are dropped without a retry.

    ``gate`` is a cheap condition on the text that any match needs.  With ``context`` the words next to a match are
    kept too."""

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    keep: Callable[[Column], Column] = lambda hit: F.lit(True)
    context: bool = False


def row_key(doc_id: str | Column, text: str | Column) -> Column:
    return F.xxhash64(doc_id, text_or_empty(text))


def last_words(x: Column) -> Column:
    """The last two words of the last line."""
    return F.substring_index(F.rtrim(F.substring_index(x, "\n", -1)), " ", -2)


def first_word(x: Column) -> Column:
    """The first word of the first line."""
    return F.substring_index(F.ltrim(F.substring_index(x, "\n", 1)), " ", 1)


def mentions(docs: DataFrame, kinds: Sequence[Kind], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``ROW``, ``kind, i, start, end, hit, before, after, joined, fresh``: one row a kept match, and one
    without kind for each document.

    ``i`` numbers the matches of a kind; ``before`` and ``after`` are the words next to it on its line, up to the
    matches on either side; ``joined`` says that only a space stands since the match before, ``fresh`` that a line
    break does.  Positions are running sums of the lengths of matches and of the stretches between them; only matches
    are shuffled, never texts."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("row_key", row_key("doc_id", "text"))
    body, no = F.col("text"), F.lit("")
    none = F.array().cast("array<struct<i:int,gap:string,hit:string,next:string>>")

    def entry(kind: Column, i: Column, gap: Column, hit: Column, before: Column, after: Column, joined: Column, fresh: Column) -> Column:
        return F.struct(kind.alias("kind"), i.alias("i"), gap.alias("gap"), hit.alias("hit"), before.alias("before"), after.alias("after"), joined.alias("joined"), fresh.alias("fresh"))

    def found(k: Kind) -> Column:
        def row(x: Column) -> Column:
            gap = x["gap"]
            near = (last_words(gap), first_word(x["next"]), gap == " ", F.contains(gap, F.lit("\n"))) if k.context else (no, no, F.lit(False), F.lit(False))
            return entry(F.lit(k.name), x["i"], F.char_length(gap), x["hit"], *near)

        return F.transform(F.coalesce(cut_by(body, k.pattern, k.gate(body)), none), row)

    marker = F.array(entry(F.lit(None).cast("string"), F.lit(0), F.lit(0), no, no, no, F.lit(False), F.lit(False)))
    rows = keyed.select("doc_id", "row_key", F.explode(F.concat(marker, *map(found, kinds))).alias("m")).select("doc_id", "row_key", "m.*").repartition("doc_id", "row_key")
    # equal rows give equal matches: the first of each belong together, and so on
    rows = rows.withColumn("row_copy", F.row_number().over(Window.partitionBy("doc_id", "row_key", "kind", "i").orderBy("gap")))
    upto = Window.partitionBy(*ROW, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("hit")).over(upto)
    keep = F.lit(None).cast("boolean")
    for k in kinds:
        keep = F.when(F.col("kind") == k.name, k.keep(F.col("hit"))).otherwise(keep)
    return (
        rows.withColumn("end", end.cast("long"))
        .withColumn("start", F.col("end") - F.char_length("hit"))
        .where(F.col("kind").isNull() | keep)
        .select(*ROW, "kind", "i", "start", "end", "hit", "before", "after", "joined", "fresh")
    )


def span_report(spans: DataFrame, base: Sequence[str], added: Sequence[str]) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans, and all spans, by start and kind."""
    order = F.lit(None).cast("int")
    for i, k in enumerate([*base, *added]):
        order = F.when(F.col("kind") == k, F.lit(i)).otherwise(order)
    listed = spans.withColumn("s", F.when(F.col("kind").isNotNull(), F.struct("start", order.alias("k"), F.concat_ws(":", "kind", "start", "end").alias("said"))))
    grouped = listed.groupBy(*ROW).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base], F.sort_array(F.collect_list("s")).alias("all"))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: x["said"]), ",")
    return grouped.select(
        "doc_id",
        *[f"n_{k}" for k in base],
        F.sha2(said(F.filter("all", lambda x: x["k"] < len(base))), 256).alias("base_sha256"),
        said(F.col("all")).alias("spans"),
    )
