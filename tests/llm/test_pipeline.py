import random

import corpus_pipeline
import pyarrow as pa
import pytest

from ridgeline.llm import decontamination, near_dedup, quality, substring_dedup


def prose(n, seed, kind="word", many=400):
    r = random.Random(seed)
    return [f"{kind}{r.randrange(many)}" if r.random() < 0.7 else f"s{seed}x{r.randrange(10**6)}" for _ in range(n)]


ITEM = [f"bench{i}" for i in range(40)]
PASSAGE = [f"pass{i}" for i in range(80)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, " ".join(prose(120, i))) for i in range(80)]
    rows += [(100 + i, " ".join(prose(100, 5000 + i, "vile", 30))) for i in range(40)]
    rows += [(200 + i, rows[i][1] + (" more" if i % 2 else "")) for i in range(10)]
    rows += [(300 + i, " ".join(prose(60, 300 + i) + PASSAGE + prose(60, 900 + i))) for i in range(6)]
    rows += [(400 + i, " ".join(prose(80, 400 + i) + ITEM)) for i in range(4)]
    rows += [(None, "a text without a number"), (500, None), (501, ""), (0, rows[0][1]), (1, "yet another text under the number of one before, word1 word2 word3")]
    path = tmp_path_factory.mktemp("sf")
    docs = [(d, t, "en", "ab"[len(t or "") % 2], len(t) if t is not None else None) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)] + [(100 + i, 1, 1) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(ITEM))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "substring_dedup", "decontamination", "mixing"]

    kept = stages["quality"](spark, docs, folder)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and not ids & set(range(100, 140)) and set(range(80)) <= ids and None not in ids and 500 not in ids
    judged = quality.quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("keep AND doc_id IS NOT NULL")
    assert kept.count() == judged.count()

    once = stages["near_dedup"](spark, docs, folder)
    gone = {r.doc_id for r in near_dedup.near_duplicates(docs).collect()}
    rows = [(r.doc_id, r.text) for r in once.collect() if r.doc_id is not None]
    left = {d for d, _ in rows}
    assert once.columns == columns and len(rows) == len(set(rows)) and set(range(200, 210)) <= gone and not gone & left
    assert left == {r.doc_id for r in docs.collect() if r.doc_id is not None} - gone
    assert len([d for d, _ in rows if d == 1]) == 2  # two different texts

    cut = stages["substring_dedup"](spark, docs, folder)
    text = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == columns and "pass5 " in text[300] and all("pass5 " not in text[300 + i] for i in range(1, 6))
    assert substring_dedup.repeated_passages(cut.where("doc_id >= 300")).count() == 0
    assert all(r.n_chars == len(r.text) for r in cut.where("doc_id BETWEEN 300 AND 305").collect())

    clean = stages["decontamination"](spark, docs, folder)
    hits = {r.doc_id for r in decontamination.contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert hits == {400, 401, 402, 403} and clean.columns == columns
    assert clean.count() == docs.count() - 4


def test_the_run_is_its_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    want = sorted(map(str, docs.collect()))
    got = sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    assert got == want and got


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0


def test_batches_of_long_texts_are_bounded_in_bytes(spark, folder):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    long = spark.range(0, 500, 1, 1).selectExpr("id", "repeat('many words ', 10000) AS text")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        spark.conf.unset(key)
        stage(spark, docs, folder)
        got = long.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in got) == 500 and max(r.bytes for r in got) < (4 << 20) + 200_000, name
    spark.conf.set(key, "100000")  # a narrower setting stays
    corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert spark.conf.get(key) == "100000"
    spark.conf.unset(key)
