"""The registered queries of this package: thin wrappers that give the operators' results in fixed columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import chat, decontaminate, fingerprints, hard_negatives, html_extract, language, mixing, packing, pii, secret_scan, simhash, substrings, vector_codes
from meshlark.llm.common import table, text_or_empty
from meshlark.llm.oracles import ORACLE_SQL  # noqa: F401  registered with the queries


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_versions(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and one made of control strings, as records in the layout that their roles fit.

    A stored conversation with the number of the added one stays apart from it."""
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text_or_empty("text").alias("text"))
    whole = rows.withColumn("given", F.lit(True)).unionByName(probe.withColumn("given", F.lit(False))).groupBy("conv_id", "given").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: F.coalesce(x["role"], F.lit(""))), " ")
    at = lambda i: F.get(F.col("t"), F.lit(i))["text"]
    pair, asked = roles == "user assistant", roles == "system user assistant"
    return whole.select(
        "conv_id",
        F.when(asked, at(0)).alias("system"),
        F.when(pair, at(0)).alias("prompt"),
        F.when(pair, at(1)).alias("response"),
        F.when(asked, at(1)).alias("instruction"),
        F.when(asked, at(2)).alias("output"),
        F.when(~pair & ~asked, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.format_chats(chat.canonical_turns(_records(spark, sf_dir)))
    whole = chat.formatted_text()
    back = made.select("conv_id", "layout", whole.alias("formatted"), chat.loss_text().alias("loss")).withColumn("turns", chat.read_back(F.col("formatted")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        pieces = packing.tokenize(table(spark, sf_dir, "documents"), f.read())
    return packing.pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprints, op2_decontamination, op3_pii, op4_substrings, op5_html, op6_simhash, op7_mixing, op8_chat, op9_language, op10_secrets, op11_vector_codes, op12_hard_negatives, op13_packing)}
