"""Queries of one-hot encoding, weights and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline import containers
from ridgeline.operators import folds, weights
from ridgeline.operators.onehot import OneHot
from ridgeline.operators.tokenizer import Tokenizer
from ridgeline.plans.registry import query
from ridgeline.plans.text import _HEX, docs

# --- one-hot ---

COLUMNS = ["c_mktsegment", "c_nationkey", "c_acctbal"]
_BITS = "o AS (SELECT DISTINCT unnest(['c_mktsegment', 'c_nationkey']) AS feature, unnest([c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer), b AS (SELECT feature, value, (row_number() OVER (ORDER BY feature, value) - 1)::INT AS bit FROM o)"
_ROWS = "x AS (SELECT c_custkey, unnest(['c_mktsegment', 'c_nationkey']) AS feature, unnest([c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer)"


def _onehot(spark, sf_dir) -> tuple[DataFrame, OneHot]:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c, OneHot.fit(c, COLUMNS, ("c_nationkey",))


@query("bool_observe", f"WITH {_BITS} SELECT feature, value FROM o")
def bool_observe(spark, sf_dir):
    return _onehot(spark, sf_dir)[1].bits.select("feature", "value")


@query("bool_finalize", f"WITH {_BITS} SELECT * FROM b")
def bool_finalize(spark, sf_dir):
    return _onehot(spark, sf_dir)[1].bits


@query("bool_encode", f"WITH {_BITS}, {_ROWS} SELECT c_custkey, bit AS col, 1.0::DOUBLE AS val FROM x JOIN b USING (feature, value)")
def bool_encode(spark, sf_dir):
    c, e = _onehot(spark, sf_dir)
    return e.encode(c, "c_custkey")


@query("bool_dense", "SELECT c_custkey, coalesce(c_acctbal, 0)::DOUBLE AS c_acctbal FROM customer")
def bool_dense(spark, sf_dir):
    c, e = _onehot(spark, sf_dir)
    return e.dense(c, "c_custkey").select("c_custkey", F.col("code")[0].alias("c_acctbal"))


@query("bool_features", f"WITH {_BITS} SELECT count(*) AS n_bits, 1::BIGINT AS n_dense FROM b")
def bool_features(spark, sf_dir):
    return _onehot(spark, sf_dir)[1].bits.agg(F.count("*").alias("n_bits")).withColumn("n_dense", F.lit(1).cast("long"))


@query("filt_restrict", f"WITH {_BITS}, {_ROWS}, k AS (SELECT feature, value, (row_number() OVER (ORDER BY bit) - 1)::INT AS bit FROM b WHERE feature = 'c_nationkey') SELECT c_custkey, bit AS col, 1.0::DOUBLE AS val FROM x JOIN k USING (feature, value)")
def filt_restrict(spark, sf_dir):
    c, e = _onehot(spark, sf_dir)
    return e.restrict(e.bits.where("feature = 'c_nationkey'")).encode(c, "c_custkey")


# --- weights, on byte unigrams of documents ---

_N = "n AS (SELECT count(*)::DOUBLE AS n FROM documents)"
_X = f"{_HEX}, g AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS x FROM h), x AS (SELECT doc_id AS \"row\", ('0x' || x)::INT AS col, count(*)::DOUBLE AS val FROM g GROUP BY ALL), {_N}"


def matrix(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    from ridgeline.operators.tokenizer import raw_counts

    return raw_counts(d, 1).select(F.col("doc_id").alias("row"), F.col("gram").cast("int").alias("col"), F.col("val").cast("double").alias("val"))


def _n(spark, sf_dir) -> int:
    return docs(spark, sf_dir).count()


def _rounded(x: DataFrame, *columns: str) -> DataFrame:
    return x.withColumns({c: F.round(c, 6) for c in columns or ("val",)})


_IDF = "idf AS (SELECT col, ln(n / count(*)) AS w FROM x, n GROUP BY col, n)"


@query("w_idf", f"WITH {_X}, {_IDF} SELECT col, round(w, 6) AS w FROM idf")
def w_idf(spark, sf_dir):
    return _rounded(weights.idf(matrix(spark, sf_dir), _n(spark, sf_dir)), "w")


@query("w_normalize", f"WITH {_X}, {_IDF}, y AS (SELECT \"row\", col, val * w AS v FROM x JOIN idf USING (col)), z AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY \"row\")) AS l FROM y) SELECT \"row\", col, round(CASE WHEN l > 0 THEN v / l ELSE v END, 6) AS val FROM z")
def w_normalize(spark, sf_dir):
    x = matrix(spark, sf_dir)
    return _rounded(weights.normalized(weights.scaled(x, weights.idf(x, _n(spark, sf_dir)))))


@query("w_standardize", f"WITH {_X}, s AS (SELECT col, sum(val * val) / n - (sum(val) / n) ** 2 AS v FROM x, n GROUP BY col, n) SELECT \"row\", col, round(val * CASE WHEN v > 1e-12 THEN 1 / sqrt(v) ELSE 1 END, 6) AS val FROM x JOIN s USING (col)")
def w_standardize(spark, sf_dir):
    return _rounded(weights.standardized(matrix(spark, sf_dir), _n(spark, sf_dir)))


@query("agg_col_sumsq", f"WITH {_X} SELECT col, sum(val * val) AS sumsq FROM x GROUP BY col")
def agg_col_sumsq(spark, sf_dir):
    return weights.sumsq(matrix(spark, sf_dir))


_RMS = "rms AS (SELECT col, CASE WHEN sum(val * val) > 0 THEN sqrt(n / sum(val * val)) ELSE 0 END AS w FROM x, n GROUP BY col, n)"


@query("agg_rms_scale", f"WITH {_X}, {_RMS} SELECT \"row\", col, round(val * w, 6) AS val FROM x JOIN rms USING (col)")
def agg_rms_scale(spark, sf_dir):
    x = matrix(spark, sf_dir)
    return _rounded(weights.scaled(x, weights.rms(x, _n(spark, sf_dir))))


@query("agg_row_norm", f"WITH {_X}, {_RMS}, q AS (SELECT \"row\", sum((val * 2.5 * w) * (val * 2.5 * w)) AS q FROM x JOIN rms USING (col) GROUP BY \"row\") SELECT doc_id AS \"row\", round(CASE WHEN q > 0 THEN 1 / sqrt(q) ELSE 0 END, 9) AS inv_norm FROM documents LEFT JOIN q ON doc_id = \"row\"")
def agg_row_norm(spark, sf_dir):
    x = matrix(spark, sf_dir)
    b = x.join(weights.rms(x, _n(spark, sf_dir)).withColumnRenamed("w", "colscale"), "col").withColumn("scale", F.lit(2.5))
    return weights.row_norms(b, docs(spark, sf_dir).withColumnRenamed("doc_id", "row")).withColumn("inv_norm", F.round("inv_norm", 9))


@query("w_center", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT i, avg(v) AS m FROM e GROUP BY i) SELECT vec_id, i::INT AS i, round(v - m, 6) AS v FROM e JOIN m USING (i)")
def w_center(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return weights.centred(e, "embedding").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.round("v", 6))


def _labels(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select(F.col("doc_id").alias("row"), F.col("lang").alias("label"))


_TAIL = lambda q: "((((({0}*q+{1})*q+{2})*q+{3})*q+{4})*q+{5})/(((({6}*q+{7})*q+{8})*q+{9})*q+1)".replace("q", f"({q})").format(-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00, 7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _probit_sql(p: str) -> str:
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
    poly = lambda c, x: f"((((({c[0]}*{x}+{c[1]})*{x}+{c[2]})*{x}+{c[3]})*{x}+{c[4]})*{x}+{c[5]})"
    q = f"({p} - 0.5)"
    r = f"({q}*{q})"
    low, high = f"sqrt(-2*ln({p}))", f"sqrt(-2*ln(1-{p}))"
    return f"CASE WHEN {p} < 0.02425 THEN {_TAIL(low)} WHEN {p} > 0.97575 THEN -({_TAIL(high)}) ELSE {poly(a, r)}*{q}/{poly(b, r)} END"


@query(
    "w_bns",
    f"""WITH {_X}, y AS (SELECT doc_id AS "row", lang AS label FROM documents), c AS (SELECT col, label, count(*)::DOUBLE AS tp FROM x JOIN y USING ("row") GROUP BY ALL),
p AS (SELECT label, count(*)::DOUBLE AS pos FROM y GROUP BY label), d AS (SELECT col, count(*)::DOUBLE AS df FROM x GROUP BY col),
r AS (SELECT col, greatest(0.0005, least(0.9995, tp / pos)) AS a, greatest(0.0005, least(0.9995, CASE WHEN n - pos > 0 THEN (df - tp) / (n - pos) ELSE 0 END)) AS b FROM c JOIN p USING (label) JOIN d USING (col), n)
SELECT col, round(max(abs(({_probit_sql("a")}) - ({_probit_sql("b")}))), 6) AS w FROM r GROUP BY col""",
)
def w_bns(spark, sf_dir):
    """Separation of the languages by each byte."""
    return _rounded(weights.bns(matrix(spark, sf_dir), _labels(spark, sf_dir), _n(spark, sf_dir)), "w")


@query(
    "w_auc",
    f"""WITH {_X}, c AS (SELECT DISTINCT col FROM x), u AS (SELECT c.col, (d.lang = 'de')::INT AS y, coalesce(x.val, 0) AS v FROM documents d CROSS JOIN c LEFT JOIN x ON x."row" = d.doc_id AND x.col = c.col),
k AS (SELECT col, y, rank() OVER (PARTITION BY col ORDER BY v) + (count(*) OVER (PARTITION BY col, v) - 1) / 2 AS r FROM u),
s AS (SELECT col, sum(y)::DOUBLE AS np, count(*)::DOUBLE - sum(y) AS nn, sum(r * y) AS rs FROM k GROUP BY col)
SELECT col, round(2 * abs((rs - np * (np + 1) / 2) / (np * nn) - 0.5), 6) AS w FROM s""",
)
def w_auc(spark, sf_dir):
    """How well each byte's count tells German documents from the others."""
    return _rounded(weights.auc(matrix(spark, sf_dir), _labels(spark, sf_dir).where("label = 'de'"), _n(spark, sf_dir)), "w")


_CS = f"{_IDF}, cs AS (SELECT col, exp(1.5 * (ln(greatest(w, 1e-6)) - avg(ln(greatest(w, 1e-6))) OVER ())) AS cs FROM idf)"


def _colscale(spark, sf_dir) -> DataFrame:
    return weights.colscale(weights.idf(matrix(spark, sf_dir), _n(spark, sf_dir)), 1.5)


@query("w_colscale", f"WITH {_X}, {_CS} SELECT col, round(cs, 6) AS cs FROM cs")
def w_colscale(spark, sf_dir):
    return _rounded(_colscale(spark, sf_dir), "cs")


_SS = "ss AS (SELECT col, sum(val * val) AS ss FROM x GROUP BY col)"


@query("w_gauge", f"WITH {_X}, {_CS}, {_SS} SELECT col, round(cs * 2 * sqrt(n / sum(cs * cs * ss) OVER ()), 6) AS w FROM cs JOIN ss USING (col), n")
def w_gauge(spark, sf_dir):
    return _rounded(weights.gauge(_colscale(spark, sf_dir), weights.sumsq(matrix(spark, sf_dir)), _n(spark, sf_dir), 2.0), "w")


@query("w_group_gauge", f"WITH {_X}, {_CS}, {_SS}, gg AS (SELECT * FROM (VALUES (0, 0, 96, 1.0), (1, 96, 128, 2.0), (2, 128, 256, 0.5)) v(\"group\", lo, hi, scale)) SELECT col, \"group\", round(cs * scale * sqrt(n / sum(cs * cs * ss) OVER (PARTITION BY \"group\")), 6) AS w FROM cs JOIN ss USING (col) JOIN gg ON col >= lo AND col < hi, n")
def w_group_gauge(spark, sf_dir):
    groups = spark.createDataFrame([(0, 0, 96, 1.0), (1, 96, 128, 2.0), (2, 128, 256, 0.5)], "group int, lo int, hi int, scale double")
    return _rounded(weights.group_gauge(_colscale(spark, sf_dir), weights.sumsq(matrix(spark, sf_dir)), groups, _n(spark, sf_dir)), "w")


@query("proj_colscale", f"WITH {_X}, {_CS} SELECT \"row\", col, round(val * cs, 6) AS val FROM x JOIN cs USING (col)")
def proj_colscale(spark, sf_dir):
    return _rounded(weights.scaled(matrix(spark, sf_dir), _colscale(spark, sf_dir).withColumnRenamed("cs", "w")))


@query("proj_hcat", f"WITH {_X} SELECT \"row\", col, val FROM x UNION ALL SELECT \"row\", col + 256 AS col, val FROM x")
def proj_hcat(spark, sf_dir):
    x = matrix(spark, sf_dir)
    return containers.hcat([(x, 256), (x, 256)])


@query("proj_rows", f"WITH {_X}, i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_row FROM documents WHERE lang = 'es') SELECT new_row AS \"row\", col, val FROM x JOIN i ON doc_id = \"row\"")
def proj_rows(spark, sf_dir):
    ids = containers.ranked(docs(spark, sf_dir).where("lang = 'es'").select(F.col("doc_id").alias("row")), "new_row", ["row"])
    return containers.gather(matrix(spark, sf_dir), ids)


@query("proj_slice_targets", "WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS \"row\" FROM orders WHERE o_orderstatus = 'O') SELECT \"row\", o_totalprice AS target FROM orders JOIN i USING (o_orderkey)")
def proj_slice_targets(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")
    ids = containers.ranked(o.where("o_orderstatus = 'O'").select("o_orderkey"), "row", ["o_orderkey"])
    return o.join(ids, "o_orderkey").select("row", F.col("o_totalprice").alias("target"))


@query("agg_label_mean", "SELECT lang AS label, count(*) / (SELECT count(*) FROM documents) AS mean FROM documents GROUP BY lang")
def agg_label_mean(spark, sf_dir):
    return weights.label_mean(_labels(spark, sf_dir), _n(spark, sf_dir))


@query("agg_target_mean", "SELECT round(avg(o_totalprice), 6) AS mean FROM orders")
def agg_target_mean(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _rounded(weights.target_mean(o.select(F.col("o_orderkey").alias("row"), F.col("o_totalprice").alias("target"))), "mean")


@query(
    "w_auc_target",
    f"""WITH {_X}, t AS (SELECT doc_id AS "row", length(text) AS target FROM documents), k AS (SELECT "row", rank() OVER (ORDER BY target NULLS FIRST) + (count(*) OVER (PARTITION BY target) - 1) / 2 AS r FROM t),
s AS (SELECT col, sum(r) AS s, count(*)::DOUBLE AS m FROM x JOIN k USING ("row") GROUP BY col)
SELECT col, round(CASE WHEN m < n THEN 2 * abs((s - m * (m + 1) / 2) / (m * (n - m)) - 0.5) ELSE 0 END, 6) AS w FROM s, n""",
)
def w_auc_target(spark, sf_dir):
    """How well a document's length tells those that have a byte from those that haven't."""
    t = docs(spark, sf_dir).select(F.col("doc_id").alias("row"), F.length("text").alias("target"))
    return _rounded(weights.auc_target(matrix(spark, sf_dir), t, _n(spark, sf_dir)), "w")


@query("w_fit_blocks", f"WITH {_X}, {_SS} SELECT col, round(3 * sqrt(n / sum(ss) OVER ()), 6) AS w FROM ss, n")
def w_fit_blocks(spark, sf_dir):
    """A block's weights without relevance: one scale for all columns."""
    x = matrix(spark, sf_dir)
    s = weights.sumsq(x)
    return _rounded(weights.block_weights(s.select("col", F.lit(1.0).alias("w")), s, _n(spark, sf_dir), None, 3.0), "w")


# --- folds ---


@query("win_fold_stratified", "SELECT doc_id, ((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 5)::INT AS fold FROM documents")
def win_fold_stratified(spark, sf_dir):
    return folds.stratified(docs(spark, sf_dir).drop("text"), "lang", "doc_id", 5).select("doc_id", "fold")


def _orders(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")


@query("win_fold_regression", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def win_fold_regression(spark, sf_dir):
    return folds.by_target(_orders(spark, sf_dir), "o_totalprice", "o_orderkey", 5).select("o_orderkey", "fold")


@query("win_quantile_bins", "SELECT o_orderkey, (ntile(16) OVER (ORDER BY o_totalprice, o_orderkey) - 1)::INT AS bin FROM orders")
def win_quantile_bins(spark, sf_dir):
    return folds.quantile_bins(_orders(spark, sf_dir), "o_totalprice", "o_orderkey").select("o_orderkey", "bin")


@query("win_doc_folds", "WITH n AS (SELECT c_custkey AS doc_id, least(count(o_orderkey), 8)::INT AS n_gold FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) SELECT doc_id, n_gold, ((row_number() OVER (PARTITION BY n_gold ORDER BY doc_id) - 1) % 5)::INT AS fold FROM n")
def win_doc_folds(spark, sf_dir):
    """Customers dealt out by how many orders they have."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"))
    return folds.by_document(c, o, 5)


@query("win_stratum_rows", "WITH n AS (SELECT count(*) AS n FROM orders), s AS (SELECT unnest(range(0, 1000)) AS i), k AS (SELECT DISTINCT (i * n) // 1000 AS pos FROM s, n), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT o_orderkey FROM o SEMI JOIN k USING (pos)")
def win_stratum_rows(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return folds.spaced(o, "o_orderkey", o.count(), 1000).select("o_orderkey")


@query("agg_class_from_labels", "WITH l AS (SELECT DISTINCT o_custkey AS \"row\", length(o_orderstatus || o_orderpriority) AS label FROM orders), f AS (SELECT label, count(*) AS freq FROM l GROUP BY label), m AS (SELECT \"row\", arg_min(label, freq * 1000 + label) AS class FROM l JOIN f USING (label) GROUP BY \"row\") SELECT c_custkey AS \"row\", coalesce(class, -1)::BIGINT AS class FROM customer LEFT JOIN m ON c_custkey = \"row\"")
def agg_class_from_labels(spark, sf_dir):
    """Customers' rarest kind of order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("row"), F.length(F.concat("o_orderstatus", "o_orderpriority")).cast("long").alias("label")).distinct()
    return folds.classes_from_labels(o, spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("row")))
