from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.containers import append, from_classes, from_mask, hcat, ranked, to_long, to_wide, validate
from ridgeline.functions import markup  # noqa: F401
from ridgeline.operators import decide, folds, kernel, retrieval, spans, weights
from ridgeline.operators.decide import Decider
from ridgeline.operators.gazetteer import Gazetteer
from ridgeline.operators.matcher import Matcher
from ridgeline.operators.onehot import OneHot
from ridgeline.operators.tokenizer import Tokenizer
from ridgeline.plans import search
from ridgeline.sources import loaders, store


def matrix(spark, x):
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v], "row long, col int, val double")


def dense(spark, x, y=None):
    return spark.createDataFrame([(i, [float(v) for v in r], [int(y[i])] if y is not None else []) for i, r in enumerate(x)], "row long, code array<double>, labels array<int>")


def collected(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- containers, folds ---


def test_ranks_and_running_sums(spark):
    rng = np.random.default_rng(0)
    x = [(int(i), float(v), "ab"[i % 2], int(i % 7)) for i, v in enumerate(rng.normal(size=500).round(1))] + [(900, None, "a", 1), (901, float("nan"), "a", 2)]
    df = spark.createDataFrame(x, "id long, v double, g string, n int")
    for buckets in (1024, 9):
        got = {r.id: r for r in ranked(df, "k", ["v", "id"], ["g"], {"t": "n"}, buckets).collect()}
        for g in "ab":
            own = sorted((r for r in x if r[2] == g), key=lambda r: (r[1] is not None, r[1] != r[1], r[1] if r[1] == r[1] and r[1] is not None else 0, r[0]))
            total = 0
            for k, r in enumerate(own):
                total += r[3]
                assert (got[r[0]].k, got[r[0]].t) == (k, total)
    assert ranked(df.where("false"), "k", ["v"]).count() == 0
    words = spark.createDataFrame([(w,) for w in ["b", "a", "", "ä", "aa", "zz"]], "w string")
    assert [r.w for r in ranked(words, "k", ["w"]).orderBy("k").collect()] == ["", "a", "aa", "b", "zz", "ä"]


def test_containers(spark):
    x = matrix(spark, [[1, 0, 2], [0, 0, 0], [3, 4, 0]])
    assert collected(to_long(to_wide(x)), "row", "col", "val") == collected(x, "row", "col", "val")
    assert collected(append(x, x, 3), "row").__len__() == 8 and hcat([(x, 3), (x, 3)]).agg(F.max("col")).first()[0] == 5
    c = spark.createDataFrame([(0, 2), (1, None)], "row long, y int")
    assert collected(from_classes(c, "y"), "row", "col") == [(0, 2)] and from_mask(c, "y > 1").count() == 1
    with pytest.raises(ValueError):
        validate(x, {"nope": ()})


def test_folds(spark):
    df = spark.createDataFrame([(i, float((i * 37) % 50), i % 3) for i in range(50)], "row long, t double, c int")
    assert folds.stratified(df, "c", "row", 5).groupBy("c", "fold").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    a, b = folds.prefix(df, "row", 0.5)
    assert (a.count(), b.count(), folds.prefix(df, "row", 1.0)[1].count()) == (25, 25, 0)
    assert {r.row for r in folds.spaced(df, "row", 50, 7).collect()} == {i * 50 // 7 for i in range(7)}
    assert folds.sample_size(100, 10) == 13 and folds.sample_size(10, 100) == 4
    labels = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (2, 1), (3, 2)], "row long, label int")
    assert collected(folds.classes_from_labels(labels, df.where("row < 5")), "row", "class") == [(0, 2), (1, 1), (2, 1), (3, 2), (4, -1)]


# --- weights ---


def test_groups_are_blocks_of_their_own(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (64, 8))
    m = matrix(spark, x)
    cs = weights.colscale(spark.createDataFrame([(j, float(v)) for j, v in enumerate(rng.uniform(0.1, 2, 8))], "col int, w double"), 1.3)
    q = weights.sumsq(m)
    groups = spark.createDataFrame([(0, 0, 3, 1.0), (1, 3, 8, 2.0)], "group int, lo int, hi int, scale double")
    got = {r.col: r.w for r in weights.group_gauge(cs, q, groups, 64).collect()}
    for lo, hi, s in ((0, 3, 1.0), (3, 8, 2.0)):
        own = {r.col: r.w for r in weights.gauge(cs.where(f"col >= {lo} AND col < {hi}"), q, 64, s).collect()}
        assert all(abs(own[c] - got[c]) < 1e-9 for c in own)
        assert abs((x[:, lo:hi] ** 2 * np.array([own[c] for c in range(lo, hi)]) ** 2).sum() / 64 - s * s) < 1e-9


def test_probit_and_auc(spark):
    from statistics import NormalDist

    p = [0.001, 0.01, 0.3, 0.5, 0.77, 0.99, 0.9995]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").select(weights.probit(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(v) for v in p], atol=1e-7)
    x = matrix(spark, [[1, 5], [2, 0], [3, 5], [0, 0]])
    y = spark.createDataFrame([(1,), (2,)], "row long")
    assert {r.col: round(r.w, 9) for r in weights.auc(x, y, 4).collect()} == {0: 1.0, 1: 0.0}


# --- kernels and models ---


def test_codes_reproduce_the_kernel(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 10))
    for kind, nu in (("cosine", 3), ("matern", 0), ("matern", 1), ("matern", 2), ("matern", 3)):
        df = dense(spark, x)
        e = kernel.nystrom_dense(kernel.landmarks(df, "row", 12 if kind == "matern" else 8), "row", "code", kind, nu, 0.5)
        c = np.array([r.code for r in e.encode(df, "row", "code").orderBy("row").collect()])
        lm = np.array([r.code for r in kernel.landmarks(df, "row", e.dims).orderBy("row").collect()])
        u, v = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (x, lm))
        codes_lm = e.codes(v)
        assert np.allclose(c @ codes_lm.T, kernel.kernel(u @ v.T, kind, nu, 0.5), atol=1e-3)
    with pytest.raises(ValueError):
        kernel.kernel(np.zeros(1), "arccos")
    assert kernel.nystrom_dense(df.where("false"), "row", "code") is None


def test_sparse_and_dense_encoders_agree(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 6)) * (rng.random((30, 6)) < 0.6)
    x[4] = 0
    ids = [1, 2, 7, 9]
    a = kernel.nystrom_dense(dense(spark, x).where(F.col("row").isin(ids)), "row", "code")
    b = kernel.nystrom_sparse(matrix(spark, x).where(F.col("row").isin(ids)))
    u = {r.row: r.code for r in a.encode(dense(spark, x), "row", "code").collect()}
    v = {r.row: r.code for r in b.encode_wide(to_wide(matrix(spark, x))).collect()}
    assert all(np.allclose(u[i], v[i], atol=1e-4) for i in v)


def test_leaving_a_fold_out_is_fitting_without_it(spark):
    rng = np.random.default_rng(4)
    x, y = rng.uniform(-1, 1, (120, 6)), rng.integers(0, 3, 120)
    df = dense(spark, x, y).withColumn("fold", (F.col("row") % 3).cast("int") - 1)
    parts = kernel.grams(df, 3, fold="fold")
    every = kernel.total(parts)
    assert every.n == 120 and set(parts) == {-1, 0, 1}
    w, b = every.less(parts[1]).solve(1e-2)
    w2, b2 = kernel.total(kernel.grams(df.where("fold <> 1"), 3)).solve(1e-2)
    assert np.allclose(w, w2) and np.allclose(b, b2)
    own, t = x[np.arange(120) % 3 != 2], np.eye(3)[y[np.arange(120) % 3 != 2]]
    xc, tc = own - own.mean(0), t - t.mean(0)
    a = xc.T @ xc
    mean = np.trace(a) / 6
    assert np.allclose(w, np.linalg.solve(a + (1e-2 * mean + 1e-6 * mean + 1e-6) * np.eye(6), xc.T @ tc))


def test_quotas_and_landmarks(spark):
    assert kernel.quotas([3, 3, 4], 5) == [2, 1, 2] and sum(kernel.quotas([1, 2, 97], 10)) == 10 and kernel.quotas([2, 1], 9) == [2, 1]
    df = spark.createDataFrame([(i, [float(i % 4)]) for i in range(20)], "row long, code array<double>")
    assert kernel.landmarks(df, "row", 9, "code").count() == 4
    with pytest.raises(ValueError):
        kernel.landmarks(df, "row", 40_000)


def blobs(n=240, seed=5):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    return np.eye(3)[y] * 2 + rng.normal(0, 0.4, (n, 3)), y


def test_a_model_learns_and_comes_back_from_disk(spark, tmp_path):
    x, y = blobs()
    pool = dense(spark, x, y)
    told = []
    m = search.krr(pool, 3, 24, knobs={"lambda": search.LAMBDA, "gamma": 1.0, "nu": 3}, k_folds=3, trials=3, ensemble=2, each=told.append)
    assert m.metrics["accuracy"] > 0.95 and sum(e["event"] == "trial" for e in told) == 3 and len(m.ridges) == 2
    before = collected(m.predict(pool), "row", "label")
    assert np.mean([a == y[i] for i, a in before]) > 0.95
    store.Bundle([], m.encoders, m.ridges, m.decider).save(str(tmp_path / "b"), spark)
    b = store.Bundle.load(str(tmp_path / "b"), spark)
    assert collected(search.Model(b.encoders, b.ridges, {}, b.decider).predict(pool), "row", "label") == before


def test_blocks_multilabel_and_regression(spark):
    x, y = blobs(90)
    b = search.fitted_blocks([search.Block(matrix(spark, np.abs(x)), 3)], spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "row long, label int"), 90, "auc")
    rows = spark.createDataFrame([(i, [int(v)]) for i, v in enumerate(y)], "row long, labels array<int>")
    m = search.krr(None, 3, 20, blocks=b, rows=rows, mode="multi", knobs={"exponents": [1.0]}, k_folds=3, trials=1)
    assert m.metrics["f1"] > 0.8 and m.decider.threshold < 1
    assert np.mean([a == y[i] for i, a in collected(m.predict(m.external(b)), "row", "label")]) > 0.85
    pool = spark.createDataFrame([(i, [float(v) for v in r], float(r[0] * 2 + 5)) for i, r in enumerate(x)], "row long, code array<double>, target double")
    assert search.krr(pool, 1, 30, mode="regression", k_folds=3, trials=1).metrics["nmae"] < 0.2
    with pytest.raises(ValueError):
        search.krr(pool, 1, 5, mode="multi")
    with pytest.raises(ValueError):
        search.krr(pool, 1, 5, mode="regression", trials=5, k_folds=1)


def test_search_finds_a_minimum():
    best, score = search.maximize(lambda p: -((p["a"] - 3) ** 2) - (np.log(p["b"]) - 1) ** 2, {"a": search.Range(-10, 10), "b": search.Range(0.01, 100, log=True), "c": search.Fixed(7)}, 160)
    assert score > -0.05 and best["c"] == 7
    assert search.maximize(lambda p: 1 / 0, {"a": search.Range(0, 1)}, 6)[1] == -np.inf
    s = search.balanced(np.array([0.3, -1.2]))
    assert s.size == 3 and abs(np.log(s).sum()) < 1e-12
    assert search.Choice((3, 0)).at(0.9) == 0 and search.Range(1, 9, whole=True).at(0.5) == 5


# --- decisions ---


def test_deciders(spark):
    s = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate([(5, 0, 0), (0.5, 0, 0.49), (0, 1, 2), (9, 8, 0)]) for j, v in enumerate(r)], "row long, label int, score double")
    assert collected(Decider(3, "single").predict(s), "row", "label") == [(0, 0), (1, 0), (2, 2), (3, 0)]
    assert Decider(3).threshold == np.inf and Decider(3).predict(s).agg(F.sum("k")).first()[0] == 0
    nothing = spark.createDataFrame([], "row long, label int")
    d, m = Decider(3).calibrated(s, nothing)
    assert d.threshold == np.inf and m["f1"] == 0
    e = spark.createDataFrame([(0, 0), (7, 1)], "row long, label int")
    assert decide.multi_metrics(s, e, 4.0)["recall"] == 1 and decide.multi_metrics(s, e, 4.0, strict=False)["recall"] == 0.5
    with pytest.raises(ValueError):
        Decider(3, "other")


@pytest.mark.parametrize("seed", range(20))
def test_schedules_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, 12, 8)
    e = s + rng.integers(1, 6, 8)
    w = rng.random(8)
    keep = decide.schedule(s, e, w)
    ok = lambda c: all(e[a] <= s[b] or e[b] <= s[a] for a, b in combinations(c, 2))
    assert ok(keep)
    assert abs(w[keep].sum() - max(w[list(c)].sum() for n in range(9) for c in combinations(range(8), n) if ok(c))) < 1e-12


def test_span_offset_by_trying_all(spark):
    rng = np.random.default_rng(6)
    cand, score, gold = [], [], []
    for i in range(60):
        at = int(rng.integers(0, 40))
        cand.append((i, i % 6, at, at + int(rng.integers(1, 8))))
        score += [(i, j, float(v)) for j, v in enumerate(rng.normal(size=3).round(2))]
        if rng.random() < 0.6:
            gold.append((i % 6, cand[-1][2], cand[-1][3], int(rng.integers(0, 2))))
    c = spark.createDataFrame(cand, "row long, doc_id long, s long, e long")
    sc = spark.createDataFrame(score, "row long, label int, score double")
    g = spark.createDataFrame(gold, "doc_id long, s long, e long, ty int").distinct()
    d, m = Decider(3, "span").calibrated(sc, cand=c, gold=g)
    margins = decide.span_margins(sc, 3, 2)
    tried = [decide.span_metrics(decide.decode(margins, c, t), g)["f1"] for t in (-2.0, -0.5, 0.0, 0.5, 1.0, 2.0)]
    assert m["f1"] >= max(tried) - 0.02  # between its breakpoints, a document's choice may shift a little
    assert m["f1"] > decide.span_metrics(decide.decode(margins, c, -2.0), g)["f1"]


# --- spans ---


def s4(spark, rows):
    return spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], "doc_id long, idx int, s long, e long, ty int")


def test_span_reports(spark):
    gold = s4(spark, [(0, 2, 1), (2, 5, 3)])
    assert [r.label for r in spans.types_of(s4(spark, [(0, 2, 0), (0, 5, 0), (2, 5, 0)]), gold, 4).orderBy("idx").collect()] == [1, 4, 3]
    rep = spans.miss_report(s4(spark, [(0, 2, 1), (5, 9, 2)]), s4(spark, []), s4(spark, [(0, 2, 0), (6, 8, 0)]))
    assert {(r.ty, r.outcome, r.by_gaz, r.by_bio, r.n) for r in rep.collect()} == {(1, "wrong_type", False, False, 1), (2, "under", False, True, 1)}
    cand = s4(spark, [(0, 2, 1), (5, 9, 4), (3, 4, 0)]).withColumnRenamed("ty", "pred")
    assert {(r.outcome, r.n) for r in spans.decode_report(s4(spark, [(0, 2, 1), (5, 9, 2)]), cand, 4).collect()} == {("correct", 1), ("false_reject", 1)}


def test_longest_agrees_with_the_matcher(spark):
    d = spark.createDataFrame([(0, "the thesis then there"), (1, "hethe")], "doc_id long, text string")
    m = Matcher.of(["the", "thesis", "he", "then", "here"])
    assert collected(spans.longest(m.predict(d)), "doc_id", "s", "e", "id") == collected(m.predict(d, longest=True), "doc_id", "s", "e", "id")


def test_gazetteer_comes_back_from_disk(spark, tmp_path):
    d = spark.createDataFrame([(0, "Barack Obama visited Paris"), (1, "Paris Hilton and Obama")], "doc_id long, text string")
    g = spark.createDataFrame([(0, 7, 12, 0), (0, 21, 26, 1), (1, 0, 5, 1), (1, 17, 22, 0)], "doc_id long, s long, e long, ty int")
    z = Gazetteer.build(d, g, 2, (3, 5))
    store.save(z, str(tmp_path / "g"), spark)
    back = store.load(str(tmp_path / "g"), spark, "gazetteer")
    columns = ("doc_id", "s", "e", "col", "val")
    assert collected(back.block(d, g, "ty"), *columns) == collected(z.block(d, g, "ty"), *columns) != []
    typed = Gazetteer.build(d, g, 2)
    assert {r.val for r in typed.block(d, g, "ty").collect()} == {1.0}
    with pytest.raises(ValueError):
        store.load(str(tmp_path / "g"), spark, "ridge")


def test_other_models_come_back(spark, tmp_path):
    d = spark.createDataFrame([(0, "abc"), (1, "bcd")], "doc_id long, text string")
    f = Tokenizer(2).fit(d)
    onehot = OneHot.fit(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double"), ["k", "v"])
    for i, model in enumerate([f, onehot, Matcher.of(["a", "b"], names=["x", "y"]), Decider(4, "span", offset=0.25)]):
        store.save(model, str(tmp_path / str(i)), spark)
        back = store.load(str(tmp_path / str(i)), spark)
        if i == 0:
            assert collected(back.transform(d), "doc_id", "col", "val") == collected(f.transform(d), "doc_id", "col", "val")
        elif i == 1:
            assert back.features() == (2, 1)
        else:
            assert back == model
    with pytest.raises(Exception):
        store.load(str(tmp_path / "none"), spark)


# --- one-hot, retrieval, loaders ---


def test_onehot(spark):
    rows = spark.createDataFrame([(0, 1, 2.0, 3.0, True), (1, 1, 5.0, 6.0, None), (2, 2, 8.0, None, False)], "row long, a int, b double, c double, d boolean")
    assert OneHot.fit(rows, ["a", "b", "c"]).features() == (0, 3)
    e = OneHot.fit(rows, ["a", "b", "c", "d"], ("a",))
    assert e.features() == (2, 3) and e.encode(rows, "row").count() == 3
    assert [list(r.code) for r in e.dense(rows, "row").orderBy("row").collect()] == [[2, 3, 1], [5, 6, 0], [8, 0, 0]]
    assert e.restrict(e.bits.where("bit = 1")).encode(rows, "row").collect()[0].asDict() == {"row": 2, "col": 0, "val": 1.0}
    assert e.encode(rows.withColumn("a", F.lit(9)), "row").count() == 0


def test_retrieval_with_all_buckets_is_brute_force(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 20))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<float>")
    index = retrieval.Index(df, "id", "v", 20)
    bits = x >= 0
    d = (bits[:, None] != bits[None]).sum(2)
    pairs = {(r.qid, r.sid): r.distance for r in index.candidates(df, 4).collect()}
    near = {(i, j) for i in range(40) for j in range(40) if min((bits[i, :16] != bits[j, :16]).sum(), (bits[i, 16:] != bits[j, 16:]).sum()) <= 4}
    assert set(pairs) == near and all(pairs[p] == d[p] for p in pairs)
    best = {}
    for r in index.of_self(df, 5, radius=4, rerank=True).collect():
        best.setdefault(r.qid, set()).add(r.sid)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    hits = sum(len(best[i] & set(np.argsort(-s[i])[:5].tolist())) for i in range(40))
    assert hits / 200 > 0.9
    store.save(index, str(tmp_path / "i"), spark)
    again = store.load(str(tmp_path / "i"), spark).search(df, 3, radius=2)
    assert collected(again, "qid", "sid", "rank") == collected(index.search(df, 3, radius=2), "qid", "sid", "rank")
    with pytest.raises(ValueError):
        retrieval.Index(df, "id", "v", 20, rerank=False).search(df, 3, rerank=True)


def test_readers(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1 0 1 7\n0 0 0 3\n")
    assert [(r.row, r.cols, r.label) for r in loaders.read_digits(spark, str(tmp_path / "d.txt"), 3).orderBy("row").collect()] == [(0, [0, 2], 7), (1, [], 3)]
    for c, t in (("pos", "good film"), ("neg", "bad film")):
        (tmp_path / "r" / c).mkdir(parents=True)
        (tmp_path / "r" / c / "1.txt").write_text(t)
    assert collected(loaders.read_reviews(spark, str(tmp_path / "r")), "text", "label") == [("bad film", 0), ("good film", 1)]
    (tmp_path / "n" / "b.cat").mkdir(parents=True)
    (tmp_path / "n" / "b.cat" / "1").write_text("From: x\n\nhello a@b.com\n> quote\nend\n--\nsig\n")
    assert loaders.read_posts(spark, str(tmp_path / "n"), addresses=True).first().text == "hello \nend"
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "train.jsonl").write_text('{"title":"t","main_body":["x","y"],"eurovoc_concepts":["9","4"]}\n')
    (tmp_path / "j" / "dev.jsonl").write_text('{"title":"u","eurovoc_concepts":["4","7"]}\n')
    (tmp_path / "j" / "test.jsonl").write_text('{"title":"v"}\n')
    assert collected(loaders.read_multilabel(spark, str(tmp_path / "j")), "part", "text", "labels") == [(0, "t\nx\ny", [0, 1]), (1, "u", [1, 2]), (2, "v", [])]
    (tmp_path / "h.csv").write_text("longitude,latitude,housing_median_age,total_rooms,total_bedrooms,population,households,median_income,median_house_value,ocean_proximity\n1,2,3,4,,6,7,8,9.5,NEAR\n1,2,3,4,5,6,7,8,,INLAND\n")
    x, e = loaders.read_housing(spark, str(tmp_path / "h.csv"))
    assert [(r.continuous, r.target) for r in x.collect()] == [([1, 2, 3, 4, 0, 6, 7, 8], 9.5)] and e.features() == (1, 0)
    (tmp_path / "c").mkdir()
    lines = "-DOCSTART- X X O\n\nEU X X B-ORG\nrejects X X O\nGerman X X I-MISC\ncall X X I-MISC\nPeter X X B-PER\nP X X B-PER\n\n\nLast X X I-LOC\n"
    for p in ("train", "valid", "test"):
        (tmp_path / "c" / f"{p}.txt").write_text(lines)
    texts, gold = loaders.read_conll(spark, str(tmp_path / "c"))["train"]
    assert collected(texts, "doc_id", "text") == [(0, "EU rejects German call Peter P"), (1, "Last")]
    assert collected(gold, "doc_id", "s", "e", "ty") == [(0, 0, 2, 1), (0, 11, 22, 3), (0, 23, 28, 0), (0, 29, 30, 0), (1, 0, 4, 2)]
