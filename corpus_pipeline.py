"""A corpus made ready for training: five stages over ``documents``, each a table for the next.

All but the last return the columns of their documents, further ones too, whatever their names (but for names that begin
with two underscores); an empty table gives an empty one.  What each does with nulls, ties and repeated rows is said below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import decontaminate, language, mixing, pii, simhash
from meshlark.llm.common import settle, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.  Null and empty texts go; repeated rows stay or go together."""
    return language.drop_unidentified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, null before all; of repeated ids one row.  Texts without
    words are copies of each other."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't give away the benchmark.  Null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked.  Null texts stay null; repeated rows are masked alike."""
    return pii.mask_pii(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how many of their words it takes.  Null sources are one source; documents without
    words are not taken; equal rows are taken each by itself."""
    kept = [c for c in docs.columns if c not in ("doc_id", "source")]
    mixed = mixing.mix(docs, keep=kept).where(F.col("taken") > 0)
    return mixed.select("doc_id", "source", *[F.col(f"kept_{c}").alias(c) for c in kept], "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Trained models, fingerprints and pattern scores have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: ``doc_id, source``, the documents' other columns, ``size, source_size, target, taken``.

    Each stage but the last is settled in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
