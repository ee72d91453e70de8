"""Queries of deciders and metrics. Scores are made of the embeddings' own dimensions: a label's score is the sum of every tenth of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import decide
from ridgeline.operators.decide import Decider
from ridgeline.plans.registry import query


def embeddings(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


def scores(spark, sf_dir) -> DataFrame:
    """(row, label, score) of ten labels."""
    each = F.array(*[F.expr(" + ".join(f"embedding[{d}]::double" for d in range(label, 64, 10))) for label in range(10)])
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("row"), F.posexplode(each).alias("label", "score"))


def expected(spark, sf_dir) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("row"), F.col("label").cast("int").alias("label"))


_EACH = f"[{', '.join(' + '.join(f'embedding[{d + 1}]::DOUBLE' for d in range(label, 64, 10)) for label in range(10))}]"
_S = f"s AS (SELECT vec_id AS \"row\", unnest({_EACH}) AS score, (generate_subscripts({_EACH}, 1) - 1)::INT AS label FROM embeddings), y AS (SELECT vec_id AS \"row\", label AS gold FROM embeddings), h AS (SELECT s.\"row\", s.label, score, (s.label = gold)::INT AS hit FROM s JOIN y USING (\"row\")), ne AS (SELECT count(*) AS ne FROM y)"
_SWEEP = f"{_S}, k AS (SELECT *, row_number() OVER w AS k, sum(hit) OVER w AS tp, lead(score) OVER w AS nxt FROM h WINDOW w AS (ORDER BY score DESC, \"row\", label)), b AS (SELECT k, tp, 2 * tp / (k + ne) AS f1, coalesce((score + nxt) / 2, score) AS threshold FROM k, ne ORDER BY f1 DESC, k LIMIT 1)"


def _one(spark, m: dict, names: list[str]) -> DataFrame:
    return spark.createDataFrame([tuple(round(float(m[k]), 9) for k in names)], ", ".join(f"{k} double" for k in names))


@query("win_fmeasure_sweep", f"WITH {_SWEEP} SELECT round(f1, 9) AS f1, round(tp / k, 9) AS precision, round(tp / ne, 9) AS recall, round(threshold, 9) AS threshold FROM b, ne")
def win_fmeasure_sweep(spark, sf_dir):
    gold = expected(spark, sf_dir)
    return _one(spark, decide.sweep(decide.with_hits(scores(spark, sf_dir), gold), gold.count()), ["f1", "precision", "recall", "threshold"])


@query("win_calibrate_multi", f"WITH {_SWEEP} SELECT round(threshold, 9) AS offset FROM b")
def win_calibrate_multi(spark, sf_dir):
    d, _ = Decider(10).calibrated(scores(spark, sf_dir), expected(spark, sf_dir))
    return _one(spark, {"offset": d.offset}, ["offset"])


@query("join_score_expected", f"WITH {_S} SELECT * FROM h")
def join_score_expected(spark, sf_dir):
    return decide.with_hits(scores(spark, sf_dir), expected(spark, sf_dir))


@query("agg_multi_prf", f"WITH {_S}, c AS (SELECT sum(hit) AS tp, count(*) AS n FROM h WHERE score >= 0.2) SELECT round(2 * tp / (n + ne), 9) AS f1, round(tp / n, 9) AS precision, round(tp / ne, 9) AS recall FROM c, ne")
def agg_multi_prf(spark, sf_dir):
    return _one(spark, decide.multi_metrics(scores(spark, sf_dir), expected(spark, sf_dir), 0.2), ["f1", "precision", "recall"])


@query("filt_threshold", f"WITH {_S} SELECT \"row\", count_if(score >= 0.1)::BIGINT AS k FROM s GROUP BY \"row\"")
def filt_threshold(spark, sf_dir):
    return Decider(10, offset=0.1).predict(scores(spark, sf_dir))


_ARG = "a AS (SELECT \"row\", label FROM (SELECT *, row_number() OVER (PARTITION BY \"row\" ORDER BY score DESC, label) AS r FROM s) WHERE r = 1)"


@query("decide_single", f"WITH {_S}, {_ARG} SELECT * FROM a")
def decide_single(spark, sf_dir):
    return Decider(10, "single").predict(scores(spark, sf_dir))


@query("agg_single_prf", f"WITH {_S}, {_ARG}, c AS (SELECT l AS label, (SELECT count(*) FROM a JOIN y USING (\"row\") WHERE a.label = l AND gold = l) AS tp, (SELECT count(*) FROM a WHERE a.label = l) AS p, (SELECT count(*) FROM y WHERE gold = l) AS g FROM range(10) t(l)) SELECT round(sum(CASE WHEN p + g > 0 THEN 2 * tp / (p + g) ELSE 0 END) / 10, 9) AS macro_f1, round(sum(tp) / sum(g), 9) AS accuracy FROM c")
def agg_single_prf(spark, sf_dir):
    return _one(spark, Decider(10, "single").score(scores(spark, sf_dir), expected(spark, sf_dir)), ["macro_f1", "accuracy"])


@query("topk_scores", f"WITH {_S} SELECT \"row\", label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY \"row\" ORDER BY score DESC, label)::INT AS rank FROM s) WHERE rank <= 3")
def topk_scores(spark, sf_dir):
    return decide.top_k(scores(spark, sf_dir), 3)


@query(
    "win_span_topw",
    f"""WITH {_S}, o AS (SELECT *, row_number() OVER (PARTITION BY "row", label = 9 ORDER BY score DESC, label) AS r FROM s),
m AS (SELECT "row", max(CASE WHEN label <> 9 AND r = 1 THEN label END) AS ty, max(CASE WHEN label <> 9 AND r = 1 THEN score END) AS best, max(CASE WHEN label <> 9 AND r = 2 THEN score END) AS second, max(CASE WHEN label = 9 THEN score END) - 0.05 AS rej FROM o GROUP BY "row")
SELECT "row", ty, round(best - greatest(second, rej), 9) AS weight FROM m WHERE best > rej""",
)
def win_span_topw(spark, sf_dir):
    m = decide.span_margins(scores(spark, sf_dir), 10, 9)
    return decide.span_weights(m, 0.05).withColumn("weight", F.round("weight", 9))


def _cand(spark, sf_dir) -> DataFrame:
    """Candidates of ten documents, half of which overlap the next one."""
    e = embeddings(spark, sf_dir)
    return e.select(F.col("vec_id").alias("row"), (F.col("vec_id") % 10).alias("doc_id"), (F.col("vec_id") * 3).alias("s"), (F.col("vec_id") * 3 + 20).alias("e"), F.col("label").cast("int").alias("ty"))


@query("win_calibrate_span")
def win_calibrate_span(spark, sf_dir):
    c = _cand(spark, sf_dir)
    d, m = Decider(10, "span").calibrated(scores(spark, sf_dir), cand=c.drop("ty"), gold=c)
    return _one(spark, m | {"offset": d.offset}, ["offset", "f1", "precision", "recall"])


@query("decide_span")
def decide_span(spark, sf_dir):
    return Decider(10, "span", offset=0.05).predict(scores(spark, sf_dir), _cand(spark, sf_dir).drop("ty"))


@query("agg_regress_accuracy", "WITH m AS (SELECT o_custkey, avg(o_totalprice) AS p FROM orders GROUP BY o_custkey), e AS (SELECT abs(p - o_totalprice) AS e, o_totalprice AS t FROM orders JOIN m USING (o_custkey)) SELECT round(sum(e), 3) AS total, round(avg(e), 6) AS mean, round(min(e), 6) AS min, round(max(e), 6) AS max, round(stddev_samp(e), 6) AS std, round(avg(e) / avg(t), 9) AS nmae FROM e")
def agg_regress_accuracy(spark, sf_dir):
    """Orders' prices predicted by their customers' means."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_totalprice")
    m = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("p"))
    r = decide.regression_metrics(o.join(m, "o_custkey"), "p", "o_totalprice")
    return r.select(F.round("total", 3).alias("total"), *[F.round(c, 6).alias(c) for c in ("mean", "min", "max", "std")], F.round("nmae", 9).alias("nmae"))
