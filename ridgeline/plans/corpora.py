"""Queries of the corpus parsers, on lines and files made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import folds
from ridgeline.plans.registry import query
from ridgeline.sources import loaders


def _digits(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    bits = F.transform("embedding", lambda v: F.when(v >= 0, "1").otherwise("0"))
    return e.select(F.col("vec_id").alias("line_no"), F.concat_ws(" ", bits, F.col("label").cast("string")).alias("value"))


@query("src_binary_mnist", "SELECT vec_id AS \"row\", (i - 1)::INT AS col, label::INT AS label FROM embeddings, range(1, 65) t(i) WHERE embedding[i] >= 0")
def src_binary_mnist(spark, sf_dir):
    return loaders.parse_digits(_digits(spark, sf_dir), 64).select("row", F.explode("cols").alias("col"), "label")


@query("split_binary_mnist", "SELECT vec_id AS \"row\", label::INT AS label, (row_number() OVER (ORDER BY vec_id) <= floor((SELECT count(*) FROM embeddings) * 0.8))::INT AS train FROM embeddings")
def split_binary_mnist(spark, sf_dir):
    a, b = folds.prefix(loaders.parse_digits(_digits(spark, sf_dir), 64).drop("cols"), "row", 0.8)
    return a.withColumn("train", F.lit(1)).unionByName(b.withColumn("train", F.lit(0)))


def _files(spark, sf_dir, category) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), category.alias("category"), "text")


_PATH = "'f' || lpad(doc_id::VARCHAR, 9, '0')"


@query("src_imdb", f"SELECT (row_number() OVER (ORDER BY md5('5:' || {_PATH}), doc_id) - 1) AS doc_id, text, (lang = 'en')::INT AS label FROM documents")
def src_imdb(spark, sf_dir):
    return loaders.parse_reviews(_files(spark, sf_dir, F.when(F.col("lang") == "en", "pos").otherwise("neg")))


@query("split_imdb", f"WITH x AS (SELECT row_number() OVER (ORDER BY md5('5:' || {_PATH}), doc_id) - 1 AS doc_id, (lang = 'en')::INT AS label FROM documents) SELECT *, (doc_id < floor((SELECT count(*) FROM x) * 0.5))::INT AS train FROM x")
def split_imdb(spark, sf_dir):
    a, b = folds.prefix(src_imdb(spark, sf_dir).drop("text"), "doc_id", 0.5)
    return a.withColumn("train", F.lit(1)).unionByName(b.withColumn("train", F.lit(0)))


def _posts(spark, sf_dir) -> DataFrame:
    f = _files(spark, sf_dir, F.col("lang"))
    return f.withColumn("text", F.concat(F.lit("From: me\nTo: you\n\n> quoted\n"), F.coalesce("text", F.lit("")), F.lit("\n--\nme")))


_CLEAN = r"array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'), lambda v: NOT regexp_matches(v, '^[ \t\n\r\f\x0b]*[>|%:]')), chr(10))"
_CLASSES = "c AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INT AS label FROM (SELECT DISTINCT lang FROM documents))"


@query("src_20newsgroups", f"WITH {_CLASSES} SELECT row_number() OVER (ORDER BY md5('5:' || {_PATH}), doc_id) - 1 AS doc_id, label, {_CLEAN} AS text FROM documents JOIN c USING (lang)")
def src_20newsgroups(spark, sf_dir):
    return loaders.parse_posts(_posts(spark, sf_dir)).select("doc_id", "label", "text")


@query("src_20newsgroups_split", f"WITH {_CLASSES}, b AS (SELECT doc_id % 4 > 0 AS train, doc_id, row_number() OVER (PARTITION BY doc_id % 4 > 0 ORDER BY md5('5:' || {_PATH}), doc_id) - 1 AS i, label, {_CLEAN} AS text FROM documents JOIN c USING (lang)) SELECT train::INT AS train, i AS doc_id, label, text FROM b")
def src_20newsgroups_split(spark, sf_dir):
    """Posts of a training and a test folder, each numbered by itself."""
    f = _posts(spark, sf_dir)
    mine = F.regexp_extract("path", "([0-9]+)[^0-9]*$", 1).cast("long") % 4 > 0
    a, b = loaders.parse_posts(f.where(mine)), loaders.parse_posts(f.where(~mine))
    return a.withColumn("train", F.lit(1)).unionByName(b.withColumn("train", F.lit(0))).select("train", "doc_id", "label", "text")


_SCRUBBED = r"regexp_replace(regexp_replace({0}, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[A-Za-z0-9]+', '', 'g'), '[A-Za-z0-9-]+\.[A-Za-z0-9-]+\.(?:edu|com|org|net|gov)', '', 'g')"


@query("clean_newsgroup", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN {_SCRUBBED.format(_CLEAN)} || chr(10) || 'write to  or see , now' ELSE {_CLEAN} END AS text FROM documents")
def clean_newsgroup(spark, sf_dir):
    """Posts without an empty line, which are all header; with addresses and a signature; with a signature after another one."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head, body = F.lit("From: me\nTo: you\n"), F.concat(F.lit("\n> quoted\n"), F.coalesce("text", F.lit("")))
    kind = F.col("doc_id") % 3
    post = F.when(kind == 0, F.concat(head, F.lit("no line is empty"))).when(kind == 1, F.concat(head, body, F.lit("\nwrite to some.body@some-where.org or see news.some.edu, now\n--\nme"))).otherwise(F.concat(head, body, F.lit("\n--\nme")))
    scrubbed = kind == 1
    return d.select("doc_id", F.when(scrubbed, loaders.clean_post(post, addresses=True)).otherwise(loaders.clean_post(post)).alias("text"))


@query(
    "src_eurlex57k",
    """WITH x AS (SELECT p_partkey AS line_no, p_name || chr(10) || p_type AS text, string_split(p_name || ' ' || p_brand, ' ') AS l FROM part),
s AS (SELECT line_no, generate_subscripts(l, 1) AS pos, unnest(l) AS name FROM x), f AS (SELECT name, min(line_no * 100 + pos) AS first FROM s GROUP BY name),
i AS (SELECT name, (row_number() OVER (ORDER BY first) - 1)::INT AS label FROM f), g AS (SELECT line_no, list_sort(list(label)) AS labels FROM s JOIN i USING (name) GROUP BY line_no)
SELECT 0 AS part, line_no, text, array_to_string(labels, ',') AS labels FROM x JOIN g USING (line_no)""",
)
def src_eurlex57k(spark, sf_dir):
    """Parts as JSON lines; the words of a part's name and its brand are its labels."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.to_json(F.struct(F.col("p_name").alias("title"), F.split(F.concat_ws(" ", "p_name", "p_brand"), " ").alias("eurovoc_concepts"), F.array("p_type").alias("main_body")))
    x = p.select(F.lit(0).alias("part"), F.col("p_partkey").alias("line_no"), line.alias("value"))
    return loaders.parse_multilabel(x).withColumn("labels", F.array_join(F.transform("labels", lambda v: v.cast("string")), ","))


def _table(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    x = c.select(F.col("c_custkey").alias("line_no"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).alias("balance"), F.col("c_nationkey").cast("string").alias("target"), F.col("c_mktsegment").alias("segment"))
    return loaders.parse_table(x, ["balance"], ["segment"], "target")


@query("src_california_housing", "SELECT row_number() OVER (ORDER BY md5('5:' || c_custkey), c_custkey) - 1 AS \"row\", greatest(c_acctbal, 0)::DOUBLE AS balance, c_nationkey::DOUBLE AS target, c_mktsegment AS segment FROM customer")
def src_california_housing(spark, sf_dir):
    return _table(spark, sf_dir)[0].select("row", F.col("continuous")[0].alias("balance"), "target", "segment")


@query("split_california_housing", "WITH x AS (SELECT row_number() OVER (ORDER BY md5('5:' || c_custkey), c_custkey) - 1 AS \"row\", c_mktsegment AS segment FROM customer), b AS (SELECT segment, (row_number() OVER (ORDER BY segment) - 1)::INT AS col FROM (SELECT DISTINCT segment FROM x)) SELECT \"row\", col, (\"row\" < floor((SELECT count(*) FROM x) * 0.8))::INT AS train FROM x JOIN b USING (segment)")
def split_california_housing(spark, sf_dir):
    x, e = _table(spark, sf_dir)
    a, b = folds.prefix(x, "row", 0.8)
    return e.encode(a, "row").drop("val").withColumn("train", F.lit(1)).unionByName(e.encode(b, "row").drop("val").withColumn("train", F.lit(0)))


def _conll(spark, sf_dir) -> DataFrame:
    """A part is a sentence of its name's two words and its type: B-PER, I-PER, B-LOC; an empty line after it."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    w = F.split("p_name", " ")
    rows = F.array(F.concat(w[0], F.lit(" X Y B-PER")), F.concat(w[1], F.lit(" X Y I-PER")), F.concat("p_type", F.lit(" X Y B-LOC")), F.lit(""))
    return p.select("p_partkey", F.posexplode(rows).alias("k", "value")).select((F.col("p_partkey") * 4 + F.col("k")).alias("line_no"), "value")


_TEXT = "x AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS doc_id, p_name, p_type, p_name || ' ' || p_type AS text FROM part)"


@query("src_conll2003", f"WITH {_TEXT} SELECT doc_id, text FROM x")
def src_conll2003(spark, sf_dir):
    return loaders.parse_conll(_conll(spark, sf_dir))[0]


@query("src_conll2003_spans", f"WITH {_TEXT} SELECT doc_id, 0::BIGINT AS s, octet_length(encode(p_name))::BIGINT AS e, 0 AS ty FROM x UNION ALL SELECT doc_id, octet_length(encode(p_name)) + 1, octet_length(encode(text)), 2 FROM x")
def src_conll2003_spans(spark, sf_dir):
    return loaders.parse_conll(_conll(spark, sf_dir))[1]


@query("merge_conll2003", f"WITH {_TEXT}, n AS (SELECT count(*) AS n FROM x) SELECT doc_id, text FROM x UNION ALL SELECT doc_id + n, text FROM x, n")
def merge_conll2003(spark, sf_dir):
    a = loaders.parse_conll(_conll(spark, sf_dir))
    return loaders.merge_conll(a, a)[0]


@query("merge_conll2003_spans", f"WITH {_TEXT}, n AS (SELECT count(*) AS n FROM x), d AS (SELECT doc_id, p_name, text FROM x UNION ALL SELECT doc_id + n, p_name, text FROM x, n) SELECT doc_id, 0::BIGINT AS s, octet_length(encode(p_name))::BIGINT AS e, 0 AS ty FROM d UNION ALL SELECT doc_id, octet_length(encode(p_name)) + 1, octet_length(encode(text)), 2 FROM d")
def merge_conll2003_spans(spark, sf_dir):
    a = loaders.parse_conll(_conll(spark, sf_dir))
    return loaders.merge_conll(a, a)[1]
