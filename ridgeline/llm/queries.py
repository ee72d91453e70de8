"""Queries opN_* and pipeline with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import ann, decontamination, html_extraction, lm_scoring, mixing, near_dedup, quality, substring_dedup, token_counts, url_filters


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary's path is the session's setting ridgeline.tokenizer."""
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), spark.conf.get("ridgeline.tokenizer", TOKENIZER))


def op2_html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "mix_source", "mix_repeats")


def op5_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows whose id is divisible by 100, against all rows."""
    return ann.neighbours(_read(spark, sf_dir, "embeddings"), asked=F.col("vec_id") % 100 == 0)


def op6_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_read(spark, sf_dir, "documents")).drop("text_hash")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass, with their scores."""
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).where("keep").select("doc_id", "score")


def op8_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.cross_entropy_difference(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents")).drop("text_hash")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_counts, op2_html_lstm, op3_decontamination, op4_mixing, op5_ivfpq, op6_chaining, op7_quality, op8_cross_entropy, op9_probminhash, op10_url_filters]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op8_cross_entropy": lm_scoring.cross_entropy_difference_sql(), "op10_url_filters": url_filters.url_filter_sql()}
