"""Readers of labelled text, digit, table and tagged corpora. Each has a parser over a DataFrame of lines or files, and a reader of paths that feeds it.

Orders that results depend on (of files, of lines, of first occurrences) are columns of the input, so a result is the same however it is partitioned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.containers import ranked
from ridgeline.functions.markup import json_values
from ridgeline.operators.folds import shuffled
from ridgeline.operators.onehot import OneHot
from ridgeline.operators.spans import bio


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, in its order. One file is one range of offsets, so the number is the place of its partition and in it."""
    return ranked(spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_m0")), "line_no", ["_m0"]).select("line_no", "value")


def first(df: DataFrame, order: str, most: int | None) -> DataFrame:
    return df if most is None else df.orderBy(order).limit(most)


# --- digits ----------------------------------------------------------------------------------------------------------


def parse_digits(x: DataFrame, n_features: int) -> DataFrame:
    """(row, cols, label) of lines (line_no, value) of n_features tokens and a label: the places of the tokens that are 1. Tokens past the label don't matter."""
    t = F.filter(F.split("value", r"\s+"), lambda v: v != "")
    ones = F.filter(F.transform(F.slice(t, 1, n_features), lambda v, i: F.when(v == "1", i)), lambda i: i.isNotNull())
    return x.select(F.col("line_no").alias("row"), ones.alias("cols"), F.get(t, F.lit(n_features)).try_cast("int").alias("label"))


def read_digits(spark: SparkSession, path: str, n_features: int, most: int | None = None) -> DataFrame:
    return parse_digits(first(lines(spark, path), "line_no", most), n_features)


# --- documents in folders --------------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, category, text): every file two levels below, the folder's name as its category."""
    return spark.read.text(f"{path}/*/*", wholetext=True).select(F.input_file_name().alias("path"), F.element_at(F.split(F.input_file_name(), "/"), -2).alias("category"), F.col("value").alias("text"))


def per_class(x: DataFrame, most: int | None) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("category").orderBy("path"))
    return x if most is None else x.withColumn("_r", r).where(F.col("_r") <= most).drop("_r")


def parse_reviews(files: DataFrame, most: int | None = None, seed: int = 5) -> DataFrame:
    """(doc_id, text, label) of files (path, category, text) in the folders pos and neg, shuffled; label is 1 for pos. `most` of each."""
    x = per_class(files.where(F.col("category").isin("pos", "neg")), most)
    return ranked(x.withColumn("_o", shuffled("path", seed=seed)), "doc_id", ["_o", "path"]).select("doc_id", "text", (F.col("category") == "pos").cast("int").alias("label"))


def read_reviews(spark: SparkSession, path: str, most: int | None = None, seed: int = 5) -> DataFrame:
    return parse_reviews(_files(spark, path), most, seed)


def clean_post(text: Column, headers: bool = True, quotes: bool = True, footers: bool = True, addresses: bool = False) -> Column:
    """A post without its header (up to the first empty line), quoted lines (> | % : after blanks) and signature (from the last line --)."""
    x = F.split(text, r"\r\n|\r|\n")
    if headers:
        at = F.array_position(x, "")
        x = F.when(at > 0, F.slice(x, at.cast("int") + 1, F.size(x))).otherwise(F.array().cast("array<string>"))
    if quotes:
        x = F.filter(x, lambda v: ~F.regexp_like(v, F.lit(r"^[ \t\n\r\f\x0B]*[>|%:]")))
    if footers:
        back = F.array_position(F.reverse(x), "--").cast("int")
        x = F.when(back > 0, F.slice(x, 1, F.size(x) - back)).otherwise(x)
    if addresses:
        x = F.transform(x, lambda v: F.regexp_replace(F.regexp_replace(v, r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[A-Za-z0-9]+", ""), r"[A-Za-z0-9-]+\.[A-Za-z0-9-]+\.(?:edu|com|org|net|gov)", ""))
    return F.array_join(x, "\n")


def parse_posts(files: DataFrame, most_per_class: int | None = None, most: int | None = None, seed: int = 5, **cleaning) -> DataFrame:
    """(doc_id, text, label) of files (path, category, text), cleaned and shuffled; label is the category's place among the sorted categories."""
    names = files.select("category").distinct().withColumn("label", F.row_number().over(Window.orderBy("category")) - 1)  # categories are few
    x = per_class(files, most_per_class).join(F.broadcast(names), "category")
    out = ranked(x.withColumn("_o", shuffled("path", seed=seed)), "doc_id", ["_o", "path"])
    out = out if most is None else out.where(F.col("doc_id") < most)
    return out.select("doc_id", clean_post(F.col("text"), **cleaning).alias("text"), "label")


def read_posts(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_posts(_files(spark, path), **options)


def read_posts_split(spark: SparkSession, train: str, test: str, **options) -> tuple[DataFrame, DataFrame]:
    return read_posts(spark, train, **options), read_posts(spark, test, **options)


# --- multi-label JSON lines ------------------------------------------------------------------------------------------

TEXT_FIELDS = ["title", "header", "recitals", "main_body"]
LABEL_FIELD = "eurovoc_concepts"


def parse_multilabel(x: DataFrame, text_fields: list[str] | None = None, label_field: str = LABEL_FIELD) -> DataFrame:
    """(part, line_no, text, labels) of JSON lines (part, line_no, value): the text fields' strings by newlines; labels numbered by where they
    occur first over all parts in order, sorted within a document."""
    x = x.select("part", "line_no", json_values(F.col("value"), text_fields or TEXT_FIELDS).alias("t"), json_values(F.col("value"), [label_field]).alias("l"))
    seen = x.select("part", "line_no", F.posexplode("l").alias("pos", "name"))
    seen = seen.groupBy("name").agg(F.min(F.struct("part", "line_no", "pos")).alias("first")).select("name", "first.*")
    ids = ranked(seen, "label", ["part", "line_no", "pos"]).select("name", F.col("label").cast("int").alias("label"))
    own = x.select("part", "line_no", F.explode("l").alias("name")).join(ids, "name").groupBy("part", "line_no").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    return x.join(own, ["part", "line_no"], "left").select("part", "line_no", F.array_join("t", "\n").alias("text"), F.coalesce("labels", F.array().cast("array<int>")).alias("labels"))


def read_multilabel(spark: SparkSession, path: str, most: int | None = None, parts: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    every = [first(lines(spark, f"{path}/{p}.jsonl"), "line_no", most).withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return parse_multilabel(reduce(DataFrame.unionByName, every))


# --- tables with a target --------------------------------------------------------------------------------------------


def parse_table(x: DataFrame, continuous: list[str], categorical: list[str], target: str, seed: int = 5) -> tuple[DataFrame, OneHot]:
    """(row, continuous, target, and the categorical columns), shuffled, and the encoder of the categories. Rows without a target go; missing
    numbers are 0. x: strings with line_no."""
    x = x.where(F.col(target).isNotNull() & (F.col(target) != ""))
    cats = {c: F.nullif(F.col(c), F.lit("")) for c in categorical}
    num = F.array(*[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in continuous])
    x = x.select("line_no", num.alias("continuous"), F.col(target).try_cast("double").alias("target"), *[v.alias(c) for c, v in cats.items()])
    x = ranked(x.withColumn("_o", shuffled("line_no", seed=seed)), "row", ["_o", "line_no"]).drop("_o")
    return x, OneHot.fit(x, categorical, tuple(categorical))


def read_housing(spark: SparkSession, path: str, most: int | None = None, seed: int = 5) -> tuple[DataFrame, OneHot]:
    x = spark.read.csv(path, header=True)
    x = first(x.withColumn("line_no", F.monotonically_increasing_id()), "line_no", most)
    return parse_table(x, ["longitude", "latitude", "housing_median_age", "total_rooms", "total_bedrooms", "population", "households", "median_income"], ["ocean_proximity"], "median_house_value", seed)


# --- tagged sentences ------------------------------------------------------------------------------------------------

TYPES = {"PER": 0, "ORG": 1, "LOC": 2, "MISC": 3}


def parse_conll(x: DataFrame, types: dict[str, int] | None = None, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, text) and spans (doc_id, s, e, ty) of lines (line_no, value) of four columns, a sentence for each stretch between empty
    lines; -DOCSTART lines drop what stands before them in their stretch. Sentences are numbered in order."""
    t = F.split(F.trim("value"), r"\s+")
    x = x.select("line_no", F.col("value"), t.alias("t"))
    blank = F.when(F.col("value") == "", 1).otherwise(0)
    start = F.when(F.col("value").startswith("-DOCSTART"), 1).otherwise(0)
    x = ranked(x.withColumns({"_b": blank, "_d": start}), "_place", ["line_no"], sums={"_sentence": "_b", "_starts": "_d"})
    words = x.where((F.size("t") >= 4) & (F.col("_b") == 0) & (F.col("_d") == 0))
    last = x.where("_d = 1").groupBy("_sentence").agg(F.max("_starts").alias("_after"))
    words = words.join(last, "_sentence", "left").where(F.col("_after").isNull() | (F.col("_starts") >= F.col("_after")))
    known = types or TYPES
    ty = F.create_map(*[v for k, n in known.items() for v in (F.lit(k), F.lit(n))])[F.substring(F.get("t", F.lit(3)), 3, 100)]
    words = words.select("_sentence", "line_no", F.get("t", F.lit(0)).alias("w"), F.substring(F.get("t", F.lit(3)), 1, 1).alias("bio"), ty.alias("ty"))
    w = Window.partitionBy("_sentence").orderBy("line_no")
    words = words.withColumn("e", F.sum(F.octet_length("w") + 1).over(w) - 1).withColumn("s", F.col("e") - F.octet_length("w"))
    ids = ranked(words.select("_sentence").distinct(), "doc_id", ["_sentence"])
    words = words.join(ids, "_sentence").withColumnRenamed("line_no", "idx").drop("_sentence")
    texts = words.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "w"))), lambda p: p["w"]), " ").alias("text"))
    return texts, bio(words.select("doc_id", "idx", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "bio", "ty"))


def read_conll(spark: SparkSession, path: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    return {p: parse_conll(lines(spark, f"{path}/{p}.txt")) for p in ("train", "valid", "test")}


def merge_conll(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two corpora as one, b's documents after a's."""
    n = a[0].count()
    return a[0].unionByName(b[0].withColumn("doc_id", F.col("doc_id") + n)), a[1].unionByName(b[1].withColumn("doc_id", F.col("doc_id") + n))
