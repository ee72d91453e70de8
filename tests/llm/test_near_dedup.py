import random

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.llm import near_dedup as nd
from ridgeline.llm.common import Work, text_buffer
from ridgeline.llm.components import components


def prose(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n)]


def edited(words, share, seed):
    r = random.Random(seed)
    return [("new" + str(r.random()) if r.random() < share else w) for w in words]


def corpus():
    rows = []
    for i in range(30):
        base = prose(60 + 20 * i, i)
        rows.append((i * 10, " ".join(base)))
        rows += [(i * 10 + k, " ".join(edited(base, 0.03 * k, 77 * i + k))) for k in (1, 2, 4)]
        rows.append((i * 10 + 9, " ".join(base)))
    return rows + [(1000 + i, " ".join(prose(80, 900 + i))) for i in range(30)]


def brute(rows, k=3, least=0.5):
    sets = {}
    for d, t in rows:
        s, c, _ = nd.weighted_sets(*text_buffer(pa.array([t], pa.large_string())), k)
        if s.size:
            sets[d] = (s, c)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if nd.probability_jaccard(*sets[a], *sets[b]) >= least:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids if root(d) != d}


def test_groups_are_those_of_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept_id for r in nd.near_duplicates(df).collect()}
    want = brute(rows)
    assert not set(got) - set(want)
    assert len(set(want) & set(got)) >= 0.97 * len(want)
    assert all(got[d] == want[d] for d in got)
    many = {r.doc_id: r.kept_id for r in nd.near_duplicates(df, driver_edges=0).collect()}
    assert many == got


def test_signatures_estimate_the_similarity():
    a = prose(300, 1)
    for share in (0.05, 0.2):
        b = edited(a, share, 5)
        s, c, doc = nd.weighted_sets(*text_buffer(pa.array([" ".join(a), " ".join(b)], pa.large_string())), 1)
        sig = nd.signatures(s, c.astype(float), doc, 2, 4096)
        first = doc == 0
        exact = nd.probability_jaccard(s[first], c[first], s[~first], c[~first])
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def test_probability_jaccard_by_its_definition():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, y = rng.integers(0, 4, 8).astype(float), rng.integers(0, 4, 8).astype(float)
        want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(8)) for i in range(8) if x[i] and y[i])
        i, j = np.flatnonzero(x), np.flatnonzero(y)
        assert abs(nd.probability_jaccard(i, x[i], j, y[j]) - want) < 1e-9


def test_thousands_of_copies(spark):
    base = " ".join(prose(40, 5))
    rows = [(i, base if i % 2 else base + f" tail{i}") for i in range(1500)] + [(5000, " ".join(prose(40, 6)))]
    got = {r.doc_id: (r.kept_id, r.group_size) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 1499 and set(got.values()) == {(0, 1500)}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (3, 4), (4, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    w = Work(spark)
    one = sorted(map(tuple, components(df, w).collect()))
    two = sorted(map(tuple, components(df, w, driver_edges=0).collect()))
    w.drop()
    assert one == two and (130, 100) in one


def test_texts_that_share_a_doc_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(prose(80, 700 + i)) for i in range(3))
    a, b = sorted((a, b))
    docs = spark.createDataFrame([(1, a, {"k": 1}), (1, b, {"k": 2}), (2, b, None), (3, c, {"k": 3}), (3, c, {"k": 4}), (0, c, None)], "doc_id long, text string, _id map<string,int>")
    copies = nd.near_duplicates(docs)
    got = sorted((r.doc_id, r.kept_id, r.text_hash is None) for r in copies.collect())
    assert got == [(1, 2, False), (3, 0, True)]
    left = sorted((r.doc_id, r.text) for r in nd.without_copies(docs, copies).collect())
    assert left == sorted([(0, c), (1, a), (2, b)])
    left = nd.without_copies(docs.where("doc_id = 3"), copies.where("false")).collect()
    assert [(r.doc_id, r._id) for r in left] == [(3, {"k": 3})]


@pytest.mark.parametrize("salt_rows", [3])
def test_salted_buckets_settle_the_same_pairs(spark, salt_rows):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert set(nd.near_duplicates(df, salt_rows=salt_rows).collect()) == set(nd.near_duplicates(df).collect())


def test_awkward_rows(spark, awkward):
    got = {tuple(r) for r in nd.near_duplicates(awkward).collect()}
    assert got == {(2, 1, 2, None)}
    assert nd.near_duplicates(awkward.where("false")).count() == 0
