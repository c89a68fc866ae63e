"""Helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.sources.settled import settled as settle  # noqa: F401  used by the operators

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def cut_by(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """The matches of ``pattern`` with the stretches of text before and after: array<struct<i, gap, hit, next>>.

    ``gate`` is a cheap necessary condition; the expression for rows that fail it is never evaluated."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)  # one more than hits
    zipped = F.slice(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("next")), 1, F.greatest(F.size(gaps) - 1, F.lit(0)))
    pairs = F.transform(zipped, lambda z, i: F.struct(i.alias("i"), z["gap"].alias("gap"), z["hit"].alias("hit"), z["next"].alias("next")))
    return pairs if gate is None else F.when(gate, pairs)


def drop_rows(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` less the rows that ``gone`` names by ``doc_id`` and ``key``, the hash of id and text.

    Rows are told apart by both, so a chance equality of hashes takes no other document; texts move only if the rows
    that go are many.  Ids that are null are equal."""
    named = gone.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(doc_id), F.col(text)) == F.col("__key"))
    return docs.join(named, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
