"""Cross-validation folds, strata and evenly spaced samples. Row order is by an explicit column, so results don't depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.containers import ranked

BINS = 16
DOC_CAP = 8


def classes_from_labels(labels: DataFrame, rows: DataFrame, row: str = "row") -> DataFrame:
    """(row, class): a row's rarest label (ties to the least), -1 for rows without labels. labels: (row, label)."""
    frequency = labels.groupBy("label").agg(F.count("*").alias("freq"))
    own = labels.join(frequency, "label").groupBy(row).agg(F.min(F.struct("freq", "label")).alias("_m")).select(row, F.col("_m.label").alias("class"))
    return rows.select(row).join(own, row, "left").select(row, F.coalesce("class", F.lit(-1)).alias("class"))


def stratified(df: DataFrame, by: str | None, order: str, k: int) -> DataFrame:
    """fold: position within the class, in the order given, modulo k; without classes the position in the table."""
    return ranked(df, "fold", [order], [by] if by else None).withColumn("fold", (F.col("fold") % k).cast("int"))


def by_target(df: DataFrame, target: str, order: str, k: int) -> DataFrame:
    """fold: rank of the target modulo k, so that every fold has all its range."""
    return ranked(df, "fold", [target, order]).withColumn("fold", (F.col("fold") % k).cast("int"))


def by_document(docs: DataFrame, gold: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """(doc, n_gold, fold): documents with about as many spans (DOC_CAP counts as the most) are dealt out in turn."""
    n = gold.groupBy(doc).agg(F.count("*").alias("_n"))
    x = docs.select(doc).join(n, doc, "left").select(doc, F.least(F.coalesce("_n", F.lit(0)), F.lit(DOC_CAP)).cast("int").alias("n_gold"))
    return stratified(x, "n_gold", doc, k)


def quantile_bins(df: DataFrame, target: str, order: str, bins: int = BINS) -> DataFrame:
    """bin: 0 .. bins - 1 by rank of the target, of even sizes (the first ones hold one row more)."""
    n = df.count()
    size, more = divmod(n, bins)
    r = F.col("bin")
    low = F.floor(r / (size + 1))
    at = F.when(r < more * (size + 1), low).otherwise(more + F.floor((r - more * (size + 1)) / size)) if size else low
    return ranked(df, "bin", [target, order]).withColumn("bin", at.cast("int"))


def sample_size(n: int, landmarks: int) -> int:
    """Rows that a search's landmarks are drawn from."""
    return max(1, min(math.ceil(landmarks * 1.3), math.floor(n * 0.4)))


def spaced(df: DataFrame, order: str, n: int, size: int) -> DataFrame:
    """The rows at floor(i * n / size) of the order, i = 0 .. size - 1: an evenly spaced sample."""
    at = F.col("_at")
    i = F.expr(f"(_at * {size} + {n} - 1) div {n}")  # the only i whose place can be here
    return ranked(df, "_at", [order]).where((F.floor(i * n / size) == at) & (i < size)).drop("_at")


def split(df: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of a fold; rows in no fold (-1) are in neither validation set, but in every training set."""
    return df.where(F.col(column) != fold), df.where(F.col(column) == fold)


def prefix(df: DataFrame, order: str, ratio: float) -> tuple[DataFrame, DataFrame]:
    """The first floor(n * ratio) rows and the rest; a ratio of 1 or more gives all and none."""
    if ratio >= 1:
        return df, df.where("false")
    n = math.floor(df.count() * ratio)
    x = ranked(df, "_at", [order])
    return x.where(F.col("_at") < n).drop("_at"), x.where(F.col("_at") >= n).drop("_at")


def shuffled(*key: str, seed: int = 5) -> Column:
    """An order by hash that any engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
