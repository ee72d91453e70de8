import random

import duckdb
import pytest

from ridgeline.llm import lm_scoring


def agree(spark, docs, labels, **options):
    got = {r.doc_id: (r.n_words, r.score) for r in lm_scoring.cross_entropy_difference(docs, labels, **options).collect()}
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    con.register("labels", labels.toPandas())
    con.sql("SET threads = 2")
    sql = lm_scoring.cross_entropy_difference_sql(**{k: v for k, v in options.items() if k == "weight"})
    want = {r[0]: (r[1], r[2]) for r in con.sql(f"SELECT doc_id, n_words, score FROM ({sql})").fetchall()}
    assert set(got) == set(want)
    for d, (n, s) in want.items():
        assert got[d][0] == n and (s is None) == (got[d][1] is None) and (s is None or abs(got[d][1] - s) < 2e-6)


@pytest.mark.parametrize("shard_words", [50, 2_000_000])
def test_scores_are_those_of_sql(spark, awkward, shard_words):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (9, 1, 0), (9, 1, 0), (6, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = awkward.where("doc_id <> 7 OR doc_id IS NULL")
    agree(spark, docs, labels, min_share=0.02, shard_words=shard_words)  # nearly all words are rare
    agree(spark, docs, labels, min_share=1.0, shard_words=shard_words)
    agree(spark, docs, labels, shard_words=shard_words, hot_pairs=1)
    agree(spark, docs, labels, shard_words=shard_words)


@pytest.mark.parametrize("options", [{}, {"min_share": 0.002, "shard_words": 3000}, {"min_share": 0.0005, "hot_pairs": 20, "shard_words": 5000}])
def test_mixed_words_by_sql(spark, options):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randint(0, 90)))) for i in range(300)] + [(7, "w1 w2 more words"), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    agree(spark, docs, labels, **options)


def test_very_long_text_and_no_labels(spark, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(awkward, labels).collect()}
    assert got[7].n_words == 60_000 and got[3].score is None and None not in got
    assert lm_scoring.cross_entropy_difference(awkward.where("false"), labels).count() == 0


def test_target_like_texts_score_lower(spark):
    rows = [(i, ("alpha beta gamma delta " if i % 2 else "one two three four ") * 10) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 20, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in lm_scoring.cross_entropy_difference(docs, labels).collect()}
    assert max(got[i] for i in range(21, 40, 2)) < min(got[i] for i in range(0, 40, 2))
