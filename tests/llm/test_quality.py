import random

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.llm import quality
from ridgeline.llm.common import text_buffer

GOOD = [f"good{i}" for i in range(60)]
JUNK = [f"junk{i}" for i in range(60)]
BAD = [f"vile{i}" for i in range(30)]
BOTH = [f"word{i}" for i in range(300)]


def text(kind, seed):
    r = random.Random(seed)
    own = {0: GOOD, 1: BAD, 2: JUNK}[kind]
    return " ".join(r.choice(own if r.random() < 0.25 else BOTH) for _ in range(r.randint(30, 120)))


@pytest.fixture(scope="module")
def tables(spark):
    kinds = [(i, i % 5) for i in range(600)]
    rows = [(i, text(0 if k < 3 else k - 2, i), "x") for i, k in kinds]
    labels = [(i, 1 if k < 3 else 0, 1 if k == 3 else 0) for i, k in kinds if i < 300]
    return spark.createDataFrame(rows, "doc_id long, text string, keep string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(kinds)


def test_held_out_documents(tables):
    docs, labels, kinds = tables
    got = {r.doc_id: r.keep for r in quality.quality_scores(docs, labels).collect()}
    held = [i for i in kinds if i >= 300]
    assert np.mean([got[i] == (kinds[i] < 3) for i in held]) > 0.95
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_votes_by_brute_force(tables):
    docs, labels, _ = tables
    m = quality.fit(docs, labels, k=5)
    texts = [text(k, 7000 + k) for k in (0, 1, 2)] + ["", "?!", "nothing known here"]
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    got = m.scores(data, offsets)
    own, term = quality.terms(data, offsets)
    z = quality.presence(own, term, len(texts), m.kept) @ m.project
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for i in (0, 1, 2, 5):
        c = m.vectors @ z[i]
        kth = np.sort(c)[-5]
        above, tied = c > kth + 1e-4, np.abs(c - kth) <= 1e-4
        w = np.maximum(c, 1e-6) ** 4 * (above + tied * (5 - above.sum()) / tied.sum())
        assert abs((w * m.good).sum() / w.sum() - got[i]) < 1e-4
    assert np.isnan(got[3])


def test_awkward_rows(spark, tables, awkward):
    _, labels, _ = tables
    docs = tables[0].select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, None), (1, 0, 1)], labels.schema))
    got = quality.quality_scores(docs, odd).collect()
    assert len(got) == docs.count()
    assert all(not r.keep for r in got if r.score is None)
    assert quality.quality_scores(docs.where("false"), odd).count() == 0
    none = quality.quality_scores(awkward, labels.where("false")).collect()
    assert len(none) == awkward.count() and all(r.score is None for r in none)
    assert quality.quality_filter(awkward, labels.where("false")).where("text IS NULL OR trim(text) = ''").count() == 0
