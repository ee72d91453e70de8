import numpy as np
import pytest

from ridgeline.llm.ann import fit, neighbours, scan


def table(spark, x, extra="x"):
    return spark.createDataFrame([(i, [float(v) for v in r], extra) for i, r in enumerate(x)], "vec_id long, embedding array<float>, rank string")


def brute(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return [sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k] for i in range(len(x))]


@pytest.mark.parametrize("kind", ["clusters", "noise"])
@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_recall(spark, kind, broadcast_bytes):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 24))
    if kind == "clusters":
        x = rng.normal(size=(30, 24))[rng.integers(0, 30, 1200)] + 0.3 * x
    rows = neighbours(table(spark, x), k=5, parts=8, shard=100, broadcast_bytes=broadcast_bytes).collect()
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour_id))
    want = brute(x, 5)
    assert len(got) == 1200 and all(len(v) == 5 for v in got.values())
    assert sum(len({n for _, n in got[i]} & set(want[i])) for i in range(1200)) / 6000 >= 0.9


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_hundreds_of_nearly_equal_vectors(spark, broadcast_bytes):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(900, 32)), *(rng.normal(size=32) + noise * rng.normal(size=(300, 32)) for noise in (0.01, 0.005, 0.002))])
    df = table(spark, x)
    got = {}
    for r in neighbours(df, k=5, asked=df["vec_id"] % 20 == 0, parts=16, shard=500, broadcast_bytes=broadcast_bytes).collect():
        got.setdefault(r.vec_id, []).append(r.similarity)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(got) == set(range(0, 1800, 20))
    hits = 0
    for i, s in got.items():
        true = y @ y[i]
        true[i] = -9
        hits += int((np.array(s) >= np.sort(np.round(true, 6))[-5] - 1e-6).sum())
    assert hits / (5 * len(got)) >= 0.95


def test_equal_vectors_and_ties(spark):
    x = [[1.0, 2.0, 3.0]] * 50 + [[3.0, 2.0, 1.0]] * 3 + [[1.0, 0.0]] * 4
    df = table(spark, x)
    got = {}
    for r in neighbours(df, k=4, asked=df["vec_id"] % 2 == 0).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append((r.neighbour_id, r.similarity))
    assert got[0] == [(i, 1.0) for i in (1, 2, 3, 4)] and got[2] == [(i, 1.0) for i in (0, 1, 3, 4)] and got[48] == [(i, 1.0) for i in range(4)]
    assert [i for i, _ in got[50]] == [51, 52, 0, 1] and [i for i, _ in got[54]] == [53, 55, 56]


def test_table_sums_are_products_with_decoded_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 10)).astype(np.float32)
    z = fit(x, 8, 3)
    lists, codes = z.encode(x)
    decoded = z.centroids[lists] + np.concatenate([z.words[p][codes[:, p]] for p in range(3)], 1)[:, :10]
    q = rng.normal(size=(4, 10)).astype(np.float32)
    for c in range(8):
        own = lists == c
        if own.any():
            assert np.allclose(scan(z.tables(q), q @ z.centroids[c], codes[own]), q @ decoded[own].T, atol=1e-4)


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0], None), (1, [1.0, 0.0], None), (2, [1.0, 0.0], "a"), (3, [0.0, 1.0], "a"), (4, None, "a"), (5, [], "a"), (6, [1.0], "a"), (10, [-2.0], "a"), (7, [None, 1.0], "a"), (None, [1.0, 1.0], "a"), (8, [0.0, 0.0], "a"), (9, [float("nan"), 1.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, q string")
    got = {(r.vec_id, r["rank"]): (r.neighbour_id, r.similarity) for r in neighbours(df, k=2).collect()}
    assert {k[0] for k in got} == {1, 2, 3, 6, 8, 10} and got[6, 1] == (10, -1.0)
    assert got[1, 1] == (2, 1.0) and got[2, 1] == (1, 1.0) and got[3, 1] == (1, 0.0) and got[8, 1][1] == 0
    assert neighbours(df.where("false")).count() == 0
    assert neighbours(df.where("vec_id = 3")).count() == 0
