"""A corpus pipeline: quality filter, near-dedup, substring dedup, decontamination and source mixing, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontamination, mixing, near_dedup, quality, substring_dedup
from ridgeline.llm.common import Work


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; rows without an id, or without words or symbols, can't be judged and go, too.
    Rows that repeat a doc_id are judged each by its own text. The classifier is trained on the labelled ones of these documents."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, and one row of each doc_id and text. Different texts under one doc_id all stay unless they are copies;
    so do rows without a doc_id, null and empty texts. Columns may have any names and types; an empty table gives no rows."""
    return near_dedup.without_copies(docs, near_dedup.near_duplicates(docs))


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out of documents that repeat one of a document with a lesser doc_id; documents of which nothing is left go. Null and empty texts and rows
    without a doc_id stay as they are; rows that repeat doc_id and text are cut alike; columns may have any names; an empty table gives no rows."""
    return substring_dedup.without_passages(docs, substring_dedup.repeated_passages(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark item. Null and empty texts hold none; repeated rows go or stay together; columns may have any names;
    an empty table, or an empty benchmark, drops nothing."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chooses documents so that sources have the shares of their tokens to the power 0.7, with mix_source and mix_repeats. Rows of one text count once;
    null texts and those without tokens are never chosen; a null source is the source ''; columns may have any other names; an empty table gives no rows."""
    return mixing.mixture(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Neither the classifier, nor ProbMinHash, nor chaining, nor weighted windows, nor the flow can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. Each stage's result is written to the shared folder and read again as the next one's documents."""
    work = Work(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir))
    out = STAGES[-1][1](spark, docs, sf_dir).checkpoint()
    work.drop()
    return out
