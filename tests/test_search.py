"""Search, span models, tokenized blocks and bundles."""

import math

import numpy as np
import pytest

from ridgeline.operators import retrieval
from ridgeline.operators.gazetteer import Gazetteer
from ridgeline.operators.tokenizer import Tokenizer
from ridgeline.plans import search
from ridgeline.sources import store


def test_span_model_finds_the_spans(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 240)  # two types, and 2 for rejection
    x = np.eye(3)[y] * 2 + rng.normal(0, 0.3, (240, 3))
    pool = spark.createDataFrame([(i, [float(v) for v in r], [int(c)]) for i, (r, c) in enumerate(zip(x, y))], "row long, code array<double>, labels array<int>")
    cand = spark.createDataFrame([(i, i // 8, 10 * (i % 8), 10 * (i % 8) + 6, int(c)) for i, c in enumerate(y)], "row long, doc_id long, s long, e long, ty int")
    gold = cand.where("ty < 2").drop("row")
    told = []
    m = search.krr(pool, 3, 24, mode="span", cand=cand, gold=gold, k_folds=3, trials=2, knobs={"lambda": search.LAMBDA}, kernel=["cosine", "matern"], each=told.append)
    assert m.metrics["f1"] > 0.9 and m.metrics["fold_std"] >= 0 and m.params["kernel"] in ("cosine", "matern")
    got = {tuple(r) for r in m.predict(pool, cand.drop("ty")).select("doc_id", "s", "e", "ty").collect()}
    want = {tuple(r) for r in gold.select("doc_id", "s", "e", "ty").collect()}
    assert 2 * len(got & want) / (len(got) + len(want)) > 0.9
    assert [e["event"] for e in told] == ["trial", "trial", "done", "profile"] and told[-1]["stats"]["grams"]["calls"] == 3
    d, own = search.decided(3, search.decide_long(m.scores(pool)), cand=cand, gold=gold)
    assert d.mode == "span" and own["f1"] > 0.9
    with pytest.raises(ValueError):
        search.krr(pool, 3, 24, mode="span", trials=1)
    with pytest.raises(ValueError):
        search.krr(pool, 3, 24, mode="span", cand=cand, gold=gold)


def test_race_and_figures():
    r = search.Race(least=3)
    assert r.lost([0.1, 0.1], 5) is None
    for s in ([0.9] * 5, [0.8] * 5, [0.85] * 5):
        r.done(s)
    assert r.lost([0.1, 0.1], 5) == pytest.approx(0.1) and r.lost([0.9, 0.9], 5) is None and r.lost([0.1], 5) is None and r.lost([0.1] * 5, 5) is None
    assert search.fold_stats([1.0, 2.0, 3.0]) == {"fold_mean": 2.0, "fold_std": 1.0} and search.fold_stats([1.0])["fold_std"] == 0
    p = search.plateau([0.5, 0.4995, 0.497, 0.2, -math.inf])
    assert p["trials"] == 4 and p["within_1e3"] == 2 and p["within_5e3"] == 3 and search.plateau([]) == {"trials": 0}
    lines = []
    log = search.Log(lines.append)
    log({"event": "trial", "n": 1, "params": {"lambda": 0.5}, "score": 0.25, "error": None})
    log({"event": "trial", "n": 2, "params": {"lambda": 0.1}, "score": 0.75, "error": None})
    log({"event": "done", "dims": 3, "params": {"lambda": 0.1}, "metrics": {"f1": 0.75}})
    log({"event": "profile", "stats": {"a": {"seconds": 1.0, "calls": 2}}, "total": 1.5})
    assert len(lines) == 5 and "score=0.250000" in lines[0] and "trials=2" in lines[3] and "a=1.00s/2" in lines[4]


TEXTS = [(i, f"{w} {v} and {w}") for i, (w, v) in enumerate([("red", "apple"), ("blue", "plum"), ("red", "plum"), ("green", "pear"), ("blue", "apple"), ("red", "pear")])]


def test_tokenized_blocks_and_bundles(spark, tmp_path):
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string")
    specs = [Tokenizer(2, 1), Tokenizer(1, mode="words")]
    known, blocks = search.tokenize_blocks(specs, texts, tokens="words")
    assert [b.n_cols for b in blocks] == [k.n_tokens() for k in known] and blocks[1].n_cols == 7
    again, frozen = search.tokenize_blocks(specs, spark.createDataFrame([(9, "red kiwi")], "doc_id long, text string"), known, tokens="words")
    assert again is known and [r.val for r in frozen[1].x.collect()] == [1.0]
    rows = spark.createDataFrame([(i, [int(t.startswith("red"))]) for i, t in TEXTS], "row long, labels array<int>")
    m = search.krr(None, 2, 6, blocks=blocks, rows=rows, knobs={"scales": [search.SCALE, search.SCALE]}, trials=0)
    assert m.params["scale_z0"] is not None
    gold = spark.createDataFrame([(i, 0, len(t.split()[0]), 0) for i, t in TEXTS], "doc_id long, s long, e long, ty int")
    b = store.Bundle(known, m.encoders, m.ridges, m.decider, Gazetteer.build(texts, gold, 1), m.weighing, spark.createDataFrame([(0, 0.5)], "col int, w double"))
    b.save(str(tmp_path / "b"), spark)
    b = store.Bundle.load(str(tmp_path / "b"), spark)
    codes = {r.row: np.array(r.code) for r in b.encode(texts, tokens="words").collect()}
    want = {r.row: np.array(r.code) for r in m.codes(m.external(blocks)).collect()}
    assert set(codes) == set(want) and all(np.allclose(codes[i], want[i]) for i in want)
    cand = gold.drop("ty").withColumnRenamed("doc_id", "row").selectExpr("row AS doc_id", "s", "e", "row")
    assert b.encode(texts, tokens="words", cand=cand).count() == len(TEXTS) and b.gaz_rms.first().w == 0.5


def test_relevance_by_a_target(spark):
    rows = [(i, [float(i)], float(i)) for i in range(40)]
    base = spark.createDataFrame(rows, "row long, code array<double>, target double")
    x = spark.createDataFrame([(i, 0, 1.0) for i in range(20, 40)] + [(i, 1, 1.0) for i in range(0, 40, 2)], "row long, col int, val double")
    b = search.fitted_blocks([search.Block(x, 2)], base.select("row", "target"), 40, "auc")[0]
    w = {r.col: r.w for r in b.relevance.collect()}
    assert w[0] == pytest.approx(1.0) and w[1] == pytest.approx(0.05)
    with pytest.raises(ValueError):
        search.fitted_blocks([search.Block(x, 2)], base.select("row", "target"), 40, "bns")


@pytest.mark.parametrize("rerank", [True, False])
def test_search_in_blocks_is_brute_force(spark, rerank):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 32))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None)], "id long, v array<float>")
    index = retrieval.Index(df, "id", "v", 32)
    q = df.where("id % 10 = 0")
    got = {}
    for r in index.search(q, 5, radius=16, oversample=60, rerank=rerank).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.sid)
    bits = x >= 0
    for i in range(0, 300, 10):
        s = x @ x[i] if rerank else -(bits != bits[i]).sum(1)
        want = sorted(range(300), key=lambda j: (-round(float(s[j]), 5), j))[:5]
        assert got[i] == want
    exact = {}
    for r in retrieval.exact(q, df, "id", "v", 5).orderBy("qid", "rank").collect():
        exact.setdefault(r.qid, []).append(r.sid)
    assert all(exact[i] == sorted(range(300), key=lambda j: (-round(float(x[i] @ x[j]), 6), j))[:5] for i in range(0, 300, 10))
