"""Queries of kernels, landmarks, normal equations, ridge models and retrieval."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import kernel, retrieval
from ridgeline.operators.kernel import Ridge
from ridgeline.plans import search
from ridgeline.plans.decisions import embeddings
from ridgeline.plans.features import _X, matrix
from ridgeline.plans.registry import query

M, DIMS = 64, 64
_LM = f"lm AS (SELECT * FROM embeddings ORDER BY md5('1:' || vec_id), vec_id LIMIT {M})"
_DOT = f"{_LM}, dot AS (SELECT e.vec_id, l.vec_id AS landmark, list_sum(list_transform(range(1, {DIMS + 1}), lambda i: e.embedding[i]::DOUBLE * l.embedding[i]::DOUBLE)) AS dot FROM embeddings e, lm l)"


def _landmarks(spark, sf_dir, m: int = M) -> DataFrame:
    return kernel.landmarks(embeddings(spark, sf_dir), "vec_id", m)


@query("uniform_landmarks", f"WITH {_LM} SELECT vec_id FROM lm")
def uniform_landmarks(spark, sf_dir):
    return _landmarks(spark, sf_dir).select("vec_id")


@query("landmarks_stratified", "WITH c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t FROM embeddings GROUP BY label), q AS (SELECT label, floor(50 * n / t) AS q, 50 * n / t - floor(50 * n / t) AS r FROM c), o AS (SELECT *, row_number() OVER (ORDER BY r DESC, label) AS k, 50 - sum(q) OVER () AS more FROM q), p AS (SELECT label, q + (k <= more)::INT AS q FROM o), e AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('1:' || vec_id), vec_id) AS r FROM embeddings) SELECT vec_id, e.label FROM e JOIN p USING (label) WHERE r <= q")
def landmarks_stratified(spark, sf_dir):
    return kernel.landmarks(embeddings(spark, sf_dir), "vec_id", 50, strata="label").select("vec_id", "label")


@query("win_dedup_first", "SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY embedding ORDER BY vec_id) AS r FROM embeddings) WHERE r = 1")
def win_dedup_first(spark, sf_dir):
    return kernel.first_of_equals(embeddings(spark, sf_dir), "embedding", "vec_id").select("vec_id")


@query("join_landmark_rep", f"WITH {_LM} SELECT e.vec_id, coalesce(min(l.vec_id), -1) AS landmark FROM embeddings e LEFT JOIN lm l ON l.embedding = e.embedding GROUP BY e.vec_id")
def join_landmark_rep(spark, sf_dir):
    """The landmark that a row equals, or -1."""
    z = kernel.fingerprint(_landmarks(spark, sf_dir), "embedding").select("fp", F.col("embedding").alias("_z"), F.col("vec_id").alias("_l"))
    x = kernel.fingerprint(embeddings(spark, sf_dir), "embedding")
    j = x.join(F.broadcast(z), (x["fp"] == z["fp"]) & (F.col("embedding") == F.col("_z")), "left")
    return j.groupBy("vec_id").agg(F.coalesce(F.min("_l"), F.lit(-1)).alias("landmark"))


@query("row_fingerprint")
def row_fingerprint(spark, sf_dir):
    return kernel.fingerprint(embeddings(spark, sf_dir), "embedding").select("vec_id", "fp")


@query("join_dense_dot", f"WITH {_DOT} SELECT vec_id, landmark, round(dot, 6) AS dot FROM dot")
def join_dense_dot(spark, sf_dir):
    return kernel.dense_dot(embeddings(spark, sf_dir), _landmarks(spark, sf_dir), "vec_id", "embedding").withColumn("dot", F.round("dot", 6))


_C = "greatest(-1, least(1, dot))"
_D = f"(2 * (1 - {_C}) * 0.7)"
_K = {0: f"exp(-sqrt({_D}))", 1: f"(1 + sqrt(3 * {_D})) * exp(-sqrt(3 * {_D}))", 2: f"(1 + sqrt(5 * {_D}) + 5 * {_D} / 3) * exp(-sqrt(5 * {_D}))", 3: f"exp(-0.7 * (1 - {_C}))"}


@query("k_matern", f"WITH {_DOT} " + " UNION ALL ".join(f"SELECT vec_id, landmark, {nu} AS nu, round({k}, 5) AS k FROM dot" for nu, k in _K.items()))
def k_matern(spark, sf_dir):
    """Each row's Matern kernels with the landmarks."""
    d = kernel.dense_dot(embeddings(spark, sf_dir), _landmarks(spark, sf_dir), "vec_id", "embedding")
    each = F.array(*[F.struct(F.lit(nu).alias("nu"), F.round(kernel.kernel(F.col("dot"), "matern", nu, 0.7), 5).alias("k")) for nu in range(4)])
    return d.select("vec_id", "landmark", F.explode(each).alias("p")).select("vec_id", "landmark", "p.nu", "p.k")


@query("k_cosine", f"WITH {_DOT} SELECT vec_id, landmark, round({_C}, 6) AS k FROM dot")
def k_cosine(spark, sf_dir):
    d = kernel.dense_dot(embeddings(spark, sf_dir), _landmarks(spark, sf_dir), "vec_id", "embedding")
    return d.select("vec_id", "landmark", F.round(kernel.kernel(F.col("dot")), 6).alias("k"))


@query("landmark_kss", f"WITH {_DOT} SELECT vec_id, landmark, round(dot, 6) AS dot FROM dot WHERE vec_id IN (SELECT vec_id FROM lm)")
def landmark_kss(spark, sf_dir):
    z = _landmarks(spark, sf_dir)
    return kernel.dense_dot(z, z, "vec_id", "embedding").withColumn("dot", F.round("dot", 6))


@query("join_sparse_dot", f"WITH {_X}, l AS (SELECT doc_id FROM documents ORDER BY md5('1:' || doc_id), doc_id LIMIT 16) SELECT a.\"row\", b.\"row\" AS landmark, sum(a.val * b.val) AS dot FROM x a JOIN x b USING (col) WHERE b.\"row\" IN (SELECT doc_id FROM l) GROUP BY ALL")
def join_sparse_dot(spark, sf_dir):
    """Products of documents' byte counts with those of 16 documents."""
    x = matrix(spark, sf_dir)
    ids = kernel.landmarks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id", 16)
    return kernel.sparse_dot(x, x.join(F.broadcast(ids.withColumnRenamed("doc_id", "row")), "row", "left_semi"))


def _codes(spark, sf_dir) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("row"), F.col("embedding").alias("code"), F.array(F.col("label").cast("int")).alias("labels"), (F.col("vec_id") % 3).cast("int").alias("fold"))


_SUM = "SELECT {0}i::INT AS i, j::INT AS j, round(sum(embedding[i + 1]::DOUBLE * embedding[j + 1]::DOUBLE), 5) AS s FROM embeddings, {1}range(64) a(i), range(64) b(j) WHERE i <= j{2} GROUP BY ALL"
_I, _J = np.triu_indices(DIMS)


@query("agg_gram", _SUM.format("", "", ""))
def agg_gram(spark, sf_dir):
    """Sums of products of all pairs of dimensions."""
    g = kernel.total(kernel.grams(_codes(spark, sf_dir).drop("fold"), 10))
    return spark.createDataFrame([(int(a), int(b), round(float(g.xx[a, b]), 5)) for a, b in zip(_I, _J)], "i int, j int, s double")


@query("agg_gram_by_fold", _SUM.format("vec_id % 3 AS fold, ", "", ""))
def agg_gram_by_fold(spark, sf_dir):
    parts = kernel.grams(_codes(spark, sf_dir), 10, fold="fold")
    rows = [(int(f), int(a), int(b), round(float(g.xx[a, b]), 5)) for f, g in parts.items() for a, b in zip(_I, _J)]
    return spark.createDataFrame(rows, "fold long, i int, j int, s double")


@query("gram_blocked", "SELECT d::INT AS d, l::INT AS label, round(sum(CASE WHEN label = l THEN embedding[d + 1]::DOUBLE ELSE 0 END), 5) AS s FROM embeddings, range(64) a(d), range(10) b(l) GROUP BY ALL")
def gram_blocked(spark, sf_dir):
    """The sums with the targets, by matrix products in Arrow batches."""
    g = kernel.total(kernel.grams(_codes(spark, sf_dir), 10))
    return spark.createDataFrame([(d, c, round(float(g.xy[d, c]), 5)) for d in range(DIMS) for c in range(10)], "d int, label int, s double")


@query("agg_gram_fold_downdate", _SUM.format("f AS fold, ", "range(3) t(f), ", " AND vec_id % 3 <> f"))
def agg_gram_fold_downdate(spark, sf_dir):
    """Sums without each fold, by subtraction."""
    parts = kernel.grams(_codes(spark, sf_dir), 10, fold="fold")
    every = kernel.total(parts)
    rows = [(int(f), int(a), int(b), round(float(x[a, b]), 5)) for f, g in parts.items() for x in [every.less(g).xx] for a, b in zip(_I, _J)]
    return spark.createDataFrame(rows, "fold long, i int, j int, s double")


def _ridge() -> Ridge:
    """Given weights: dimension d counts (d + 1) / 64 for label d mod 10."""
    w = np.zeros((DIMS, 10))
    w[np.arange(DIMS), np.arange(DIMS) % 10] = (np.arange(DIMS) + 1) / 64
    return Ridge(w, np.arange(10) / 100)


_SCORE = "s AS (SELECT vec_id AS \"row\", l::INT AS label, list_sum(list_transform(range(0, 64), lambda d: CASE WHEN d % 10 = l THEN embedding[d + 1]::DOUBLE * (d + 1) / 64 ELSE 0 END)) + l / 100 AS score FROM embeddings, range(10) t(l))"


@query("ridge_regress", f"WITH {_SCORE} SELECT \"row\", label, round(score::FLOAT::DOUBLE, 5) AS score FROM s")
def ridge_regress(spark, sf_dir):
    return kernel.long_scores(_ridge().regress(_codes(spark, sf_dir))).withColumn("score", F.round(F.col("score").cast("double"), 5))


@query("topk_label", f"WITH {_SCORE} SELECT \"row\", label, rank FROM (SELECT *, row_number() OVER (PARTITION BY \"row\" ORDER BY score::FLOAT DESC, label)::INT AS rank FROM s) WHERE rank <= 3")
def topk_label(spark, sf_dir):
    return _ridge().label(_codes(spark, sf_dir), 3).drop("score")


@query("nystrom_encode")
def nystrom_encode(spark, sf_dir):
    e = kernel.nystrom_dense(_landmarks(spark, sf_dir), "vec_id", "embedding", "matern", 1, 0.7)
    return e.encode(embeddings(spark, sf_dir), "vec_id", "embedding")


@query("gram_solve")
def gram_solve(spark, sf_dir):
    """Labels of the embeddings by ridge regression on themselves."""
    r = Ridge.from_gram(kernel.total(kernel.grams(_codes(spark, sf_dir), 10)), 1e-3)
    return r.label(_codes(spark, sf_dir), 1)


@query("krr_dense")
def krr_dense(spark, sf_dir):
    """Labels of the embeddings by a kernel ridge model whose decider is calibrated out of fold."""
    pool = _codes(spark, sf_dir).drop("fold")
    m = search.krr(pool, 10, M, kernel="matern", knobs={"lambda": 1e-3, "gamma": 1.0, "nu": 3}, trials=1)
    return m.predict(pool)


@query("krr_span")
def krr_span(spark, sf_dir):
    """Spans among candidates by a kernel ridge model: its decider is calibrated out of fold, by whole documents. Each vector is a candidate; label 9 is rejection."""
    pool = _codes(spark, sf_dir).drop("fold")
    e = embeddings(spark, sf_dir)
    cand = e.select(F.col("vec_id").alias("row"), F.expr("vec_id div 10").alias("doc_id"), (F.col("vec_id") % 10 * 3).alias("s"), (F.col("vec_id") % 10 * 3 + 4).alias("e"), F.col("label").cast("int").alias("ty"))
    m = search.krr(pool, 10, M, mode="span", cand=cand, gold=cand.where("ty < 9").drop("row"), kernel="matern", knobs={"gamma": 1.0, "nu": 3}, trials=1)
    return m.predict(pool, cand.drop("ty"))


@query("agg_fold_stats", "WITH m AS (SELECT vec_id % 5 AS fold, avg(embedding[1]::DOUBLE) AS m FROM embeddings GROUP BY fold) SELECT round(avg(m), 9) AS fold_mean, round(stddev_samp(m), 9) AS fold_std FROM m")
def agg_fold_stats(spark, sf_dir):
    """Mean and deviation of what each fold scores."""
    f = embeddings(spark, sf_dir).groupBy((F.col("vec_id") % 5).alias("fold")).agg(F.avg(F.col("embedding")[0].cast("double")).alias("m"))
    r = search.fold_stats([x.m for x in f.collect()])
    return spark.createDataFrame([(round(r["fold_mean"], 9), round(r["fold_std"], 9))], "fold_mean double, fold_std double")


@query("agg_plateau_log", "WITH t AS (SELECT l_linenumber, avg(l_discount)::DOUBLE AS score FROM lineitem GROUP BY l_linenumber), b AS (SELECT max(score) AS best FROM t) SELECT count(*) AS trials, round(max(best), 9) AS best, count_if(score >= best - 0.001) AS within_1e3, count_if(score >= best - 0.005) AS within_5e3 FROM t, b")
def agg_plateau_log(spark, sf_dir):
    """How many of a search's trials come near the best one."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_linenumber").agg(F.avg(F.col("l_discount").cast("double")).alias("score"))
    p = search.plateau([x.score for x in t.collect()])
    return spark.createDataFrame([(p["trials"], round(p["best"], 9), p["within_1e3"], p["within_5e3"])], "trials long, best double, within_1e3 long, within_5e3 long")


# --- retrieval ---

_W = "c AS (SELECT vec_id, embedding, list_transform(range(0, 4), lambda t: list_sum(list_transform(range(0, 16), lambda j: CASE WHEN embedding[t * 16 + j + 1] >= 0 THEN 1 << j ELSE 0 END))::INT) AS w FROM embeddings)"
_PAIR = f"{_W}, p AS (SELECT a.vec_id AS qid, b.vec_id AS sid, list_transform(range(1, 5), lambda t: bit_count(xor(a.w[t], b.w[t]))::INT) AS d FROM c a, c b WHERE a.vec_id % 100 = 0)"
_NEAR = f"{_PAIR}, n AS (SELECT qid, sid, list_sum(d)::INT AS distance FROM p WHERE list_min(d) <= 3)"


@query("ann_create", f"WITH {_W} SELECT vec_id AS sid, (generate_subscripts(w, 1) - 1)::INT AS t, unnest(w) AS bucket FROM c")
def ann_create(spark, sf_dir):
    return retrieval.Index(embeddings(spark, sf_dir), "vec_id", "embedding", DIMS).buckets().drop("swords")


def _asked(e: DataFrame) -> DataFrame:
    """The queries: rows whose id is divisible by 100, against all rows."""
    return e.where("vec_id % 100 = 0")


@query("join_ann_probe", f"WITH {_NEAR} SELECT * FROM n")
def join_ann_probe(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return retrieval.Index(e, "vec_id", "embedding", DIMS).candidates(_asked(e), 3)


@query("hamming", f"WITH {_PAIR} SELECT qid, sid, list_sum(d)::INT AS distance FROM p")
def hamming(spark, sf_dir):
    """All pairs of a query and a row: one exclusive or of 64 bits each, as the pairs are quadratic."""
    e = embeddings(spark, sf_dir).select("vec_id", retrieval.sign_long("embedding", DIMS).alias("w"))
    q = _asked(e).toDF("qid", "_w")
    return e.crossJoin(F.broadcast(q)).select("qid", F.col("vec_id").alias("sid"), F.bit_count(F.col("w").bitwiseXOR(F.col("_w"))).alias("distance"))


_ALL = f"{_PAIR}, n AS (SELECT qid, sid, list_sum(d)::INT AS distance FROM p)"


@query("topk_ann", f"WITH {_ALL}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, sid)::INT AS rank FROM n) SELECT qid, sid, distance, rank, 1 - distance / 64 AS similarity FROM k WHERE rank <= 5")
def topk_ann(spark, sf_dir):
    """The five nearest by Hamming distance."""
    e = embeddings(spark, sf_dir)
    return retrieval.Index(e, "vec_id", "embedding", DIMS, rerank=False).search(_asked(e), 5, radius=16)


_DOTS = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
#: These vectors have so little structure that 30 % of all rows must be reranked for a recall of 0.9.
RERANKED = 0.06


@query("topk_ann_rerank", f"WITH {_ALL}, m AS (SELECT 5 * ceil({RERANKED} * count(*)) AS m FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, sid) AS r FROM n), d AS (SELECT qid, sid, distance, {_DOTS} AS similarity FROM k JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = sid, m WHERE r <= m), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(similarity, 9) DESC, sid)::INT AS rank FROM d) SELECT qid, sid, distance, rank, round(similarity, 5) AS similarity FROM t WHERE rank <= 5")
def topk_ann_rerank(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    found = retrieval.Index(e, "vec_id", "embedding", DIMS).search(_asked(e), 5, radius=16, oversample=int(np.ceil(RERANKED * e.count())))
    return found.withColumn("similarity", F.round("similarity", 5))


@query("ann_self", f"WITH {_ALL}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, sid)::INT AS rank FROM n WHERE qid <> sid) SELECT qid, sid, distance, rank, 1 - distance / 64 AS similarity FROM k WHERE rank <= 5")
def ann_self(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return retrieval.Index(e, "vec_id", "embedding", DIMS, rerank=False).of_self(_asked(e), 5, radius=16)


@query("topk_exact", f"WITH d AS (SELECT a.vec_id AS qid, b.vec_id AS sid, round({_DOTS}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, sid)::INT AS rank FROM d) SELECT qid, sid, similarity, rank FROM k WHERE rank <= 10")
def topk_exact(spark, sf_dir):
    """The ten nearest among all rows."""
    e = embeddings(spark, sf_dir)
    return retrieval.exact(_asked(e), e, "vec_id", "embedding", 10)
