import gc
import os
import random
import time

import numpy as np
import pytest

from ridgeline.llm import substring_dedup as sd
from ridgeline.llm.common import Work


def prose(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n)]


def test_repeated_passages_are_found_with_their_bounds(spark):
    rows, want = [], {}
    for i in range(12):
        passage = prose(60 + 15 * i, 40_000 + i)
        for k in range(3):
            head = prose(20 * k + i, 10_000 + 10 * i + k)
            rows.append((i * 10 + k, " ".join(head + passage + prose(30, 20_000 + 10 * i + k))))
            if k:
                want[i * 10 + k] = (len(head), len(head) + len(passage), i * 10)
    rows += [(900 + i, " ".join(prose(150, 30_000 + i))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sd.repeated_passages(df).collect()}
    assert set(got) == set(want)
    for d, (lo, hi, source) in want.items():
        assert abs(got[d].first_word - lo) <= 1 and abs(got[d].end_word - hi) <= 1 and got[d].source_id == source
    left = {r.doc_id: r.text for r in sd.without_passages(df, sd.repeated_passages(df)).collect()}
    text = dict(rows)
    for d, (lo, hi, _) in want.items():
        w = text[d].split()
        assert abs(len(left[d].split()) - (len(w) - (hi - lo))) <= 2
    assert all(left[d] == text[d] for d in text if d not in want)


def test_fuzzy_passages(spark):
    passage = prose(120, 1)
    other = list(passage)
    for at in range(20, 120, 20):
        other[at] = "edit" + str(at)
    del other[50:53]
    rows = [(1, " ".join(prose(40, 2) + passage + prose(40, 3))), (2, " ".join(prose(70, 4) + other + prose(10, 5)))]
    got = sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0].doc_id == 2 and got[0].end_word - got[0].first_word >= 110


def test_short_repeats_and_clean_documents_stay(spark):
    shared = prose(30, 7)
    rows = [(i, " ".join(prose(80, 40 + i) + shared + prose(80, 80 + i))) for i in range(6)]
    assert sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_each_copy_in_a_later_document_of_another_batch_is_found(spark):
    passage = prose(80, 21)
    a = spark.createDataFrame([(1, " ".join(prose(40, 22) + passage + prose(40, 23)))], "doc_id long, text string")
    b = spark.createDataFrame([(2, " ".join(prose(50, 24) + passage + prose(100, 25) + passage + prose(60, 26) + passage))], "doc_id long, text string")
    docs = a.unionAll(b)
    passages = sd.repeated_passages(docs)
    got = sorted((r.doc_id, r.first_word, r.end_word, r.source_id) for r in passages.collect())
    assert [g[0::3] for g in got] == [(2, 1)] * 3
    assert all(abs(g[1] - lo) <= 1 and abs(g[2] - lo - 80) <= 1 for g, lo in zip(got, (50, 230, 370)))
    left = {r.doc_id: len(r.text.split()) for r in sd.without_passages(docs, passages).collect()}
    assert left[1] == 160 and abs(left[2] - 210) <= 6


def test_pieces_make_a_passage_only_if_one_document_holds_them_all(spark):
    x, y = prose(32, 31), prose(32, 32)
    rows = [(i + 1, " ".join(prose(60, 40 + i) + phrase + prose(60, 50 + i))) for i, phrase in enumerate((x, y, x + y))]
    assert sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    rows.append((4, " ".join(prose(20, 60) + x + y + prose(20, 61))))
    got = sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.first_word, r.end_word, r.source_id) for r in got] == [(4, 20, 84, 3)]


def test_result_is_the_same_however_rows_fall_into_batches(spark):
    r = random.Random(5)
    lines = [prose(r.randint(8, 40), 600 + i) for i in range(12)]
    passages = [prose(70, 650 + i) for i in range(4)]
    rows = [(i, " ".join(sum((r.choice(lines) if r.random() < 0.6 else prose(25, 700 + 9 * i + j) for j in range(4)), []) + r.choice(passages) + r.choice(lines) + r.choice(lines))) for i in range(60)]
    rows += [(5, " ".join(prose(30, 690) + passages[0])), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(sd.repeated_passages(docs.coalesce(1)).collect())
    assert len(want) >= 50
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most, files in ((1, 3), (7, 1), (10, 5)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            assert set(sd.repeated_passages(docs.repartition(files, "text")).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("edits", [0.1, 0.15])
def test_lightly_edited_passages_are_found(spark, edits):
    r = random.Random(9)
    rows, n = [], 60
    for i in range(n):
        p = prose(80, 3000 + i)
        q = [f"edit{i}x{j}" if r.random() < edits else w for j, w in enumerate(p)]
        rows += [(i, " ".join(prose(40, 3100 + i) + p)), (1000 + i, " ".join(prose(40, 3200 + i) + q + prose(20, 3300 + i)))]
    got = {x.doc_id: x.source_id for x in sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] == d - 1000 for d in got) and len(got) >= (0.9 if edits < 0.12 else 0.75) * n


@pytest.mark.parametrize("seed", range(30))
def test_first_chain_scores_as_well_as_by_all_pairs(seed):
    rng, k = random.Random(seed), 6
    m = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(25)})
    pb, pa_ = np.array([x[0] for x in m]), np.array([x[1] for x in m])

    def step(i, j):
        gb, ga = pb[i] - pb[j], pa_[i] - pa_[j]
        return min(k, gb, ga) - sd.GAP_COST * (gb + ga) if gb > 0 and ga > 0 else None

    def total(chain):
        return k + sum(step(b, a) for a, b in zip(chain, chain[1:]))

    got = sd.chains(pb, pa_, k)
    assert sorted(i for c in got for i in c) == list(range(len(m)))
    for c in got:
        assert all(pb[b] > pb[a] and pa_[b] > pa_[a] for a, b in zip(c, c[1:]))
    # a chain's score in the tree counts overlaps in full: it is a bound that the first chain meets without overlaps
    far = sorted({(7 * a, 7 * b) for a, b in m})
    pb, pa_ = np.array([x[0] for x in far]), np.array([x[1] for x in far])
    best = [k] * len(far)
    for i in range(len(far)):
        best[i] = max([k, *(best[j] + step(i, j) for j in range(i) if step(i, j) is not None)])
    assert abs(total(sd.chains(pb, pa_, k)[0]) - max(best)) < 1e-9


def test_awkward_rows(spark, awkward):
    assert {r.doc_id for r in sd.repeated_passages(awkward).collect()} == set()
    long = awkward.where("doc_id = 7").unionByName(awkward.where("doc_id = 7").selectExpr("20L AS doc_id", "text", "source", "id", "score"))
    got = sd.repeated_passages(long.unionByName(awkward)).collect()
    assert [(r.doc_id, r.first_word, r.source_id) for r in got] == [(20, 0, 7)] and got[0].end_word == 60_000
    cut = sd.without_passages(long.unionByName(awkward), sd.repeated_passages(long.unionByName(awkward)))
    assert cut.columns == awkward.columns and cut.where("doc_id = 20").count() == 0 and cut.count() == awkward.count() + 1
    assert sd.repeated_passages(awkward.where("false")).count() == 0


def _shuffle_files(spark):
    return sum(len(names) for p in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for _, _, names in os.walk(p) for names in [[n for n in names if n.startswith("shuffle_")]])


def test_a_work_table_leaves_no_shuffle_files(spark):
    work = Work(spark)
    gc.collect()
    before = _shuffle_files(spark)
    out = work.table(spark.range(1000).selectExpr("id % 100 AS k").repartition(7, "k"))
    for _ in range(50):  # they are removed in the background
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before
    assert out.count() == 1000
    work.drop()


def test_rounds_hold_every_pair_once_and_bounded_texts(spark):
    texts = spark.createDataFrame([(i, "x" * 100) for i in range(20)], "doc_id long, text string")
    chained = spark.createDataFrame([(b, a, [0, 6, 0]) for b in range(20) for a in range(b)], "b long, a long, parts array<int>")
    work = Work(spark)
    parts = sd._rounds(texts, chained, work, least=1)
    assert len(parts) == 4  # 190 texts of pairs, 20 texts in all
    assert sorted((r.b, r.a) for p in parts for r in p.collect()) == sorted((r.b, r.a) for r in chained.collect())
    assert max(p.count() for p in parts) < 120
    assert len(sd._rounds(texts, chained, work)) == 1
    work.drop()
