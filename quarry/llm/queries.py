"""Queries opN_<name> of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark, common.table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import without_repeats

    return without_repeats(spark, common.table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept_text")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_round_trip

    return token_file_round_trip(spark, common.table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    out = mixed(spark, common.table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))
    return out.withColumn("rate", F.round("rate", 9))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(spark, common.table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    documents = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity(spark, documents, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    out = judged(spark, common.table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return out.withColumns({c: F.round(c, 6) for c in ("character_divergence", "word_divergence")})


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import linked_vectors

    return linked_vectors(spark, common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extraction import extracted

    return extracted(common.table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(common.table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_substring_dedup, op3_token_files, op4_mixing, op5_simhash, op6_toxicity, op7_quality, op8_embeddings, op9_extraction, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    """Op 2, 7 and 8; the others rest on a tokenizer, XXH64, trained models or zstandard and are tested against brute force."""
    from . import oracles

    return {"op2_substring_dedup": oracles.OP2, "op7_quality": oracles.OP7, "op8_embeddings": oracles.OP8}
