import heapq

import numpy as np
import pytest

from ridgeline.llm.mixing import min_cost_flow, mixture


def shortest_paths(capacity, member, quota, repeats):
    """Cost and amount of the best flow by successive shortest paths, one arc at a time."""
    P, S = len(capacity), len(quota)
    n, sink = P + S + 2, P + S + 1
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]

    def arc(a, b, c, w):
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y), cap.append(z), cost.append(v)

    for p in range(P):
        for r in range(repeats):
            arc(0, 1 + p, capacity[p], r * (r + 1) // 2)
        for s in member[p]:
            arc(1 + p, 1 + P + s, 10**9, 0)
    for s in range(S):
        arc(1 + P + s, sink, quota[s], 0)
    total = spent = 0
    while True:
        dist, via = [10**18] * n, [-1] * n
        dist[0] = 0
        for _ in range(n):
            for u in range(n):
                for e in out[u]:
                    if cap[e] and dist[u] + cost[e] < dist[to[e]]:
                        dist[to[e]], via[to[e]] = dist[u] + cost[e], e
        if dist[sink] > 10**17:
            return total, spent
        path, u = [], sink
        while u:
            path.append(via[u])
            u = to[via[u] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
        total, spent = total + push, spent + push * dist[sink]


@pytest.mark.parametrize("seed", range(25))
def test_flow_is_as_cheap_as_by_shortest_paths(seed):
    rng = np.random.default_rng(seed)
    P, S, repeats = rng.integers(1, 7), rng.integers(1, 5), int(rng.integers(1, 4))
    capacity = rng.integers(1, 30, P)
    member = [sorted(rng.choice(S, rng.integers(1, S + 1), replace=False).tolist()) for _ in range(P)]
    quota = rng.integers(0, 60, S)
    edge_p = np.array([p for p in range(P) for _ in member[p]])
    edge_s = np.array([s for m in member for s in m])
    flow = min_cost_flow(capacity, edge_p, edge_s, quota, repeats)
    assert (flow >= 0).all() and (np.bincount(edge_s, flow, S) <= quota).all()
    sent = np.bincount(edge_p, flow, P).astype(int)
    cost = sum(int(np.clip(sent - r * capacity, 0, capacity).sum()) * (r * (r + 1) // 2) for r in range(repeats))
    assert (sent <= capacity * repeats).all()
    assert (int(sent.sum()), cost) == shortest_paths(capacity.tolist(), member, quota.tolist(), repeats)


@pytest.mark.parametrize("seed", range(25))
def test_many_passes_cost_as_little_as_by_shortest_paths(seed):
    rng = np.random.default_rng(100 + seed)
    P, S, repeats = rng.integers(1, 5), rng.integers(1, 4), 25
    capacity = rng.integers(1, 6, P)
    member = [sorted(rng.choice(S, rng.integers(1, S + 1), replace=False).tolist()) for _ in range(P)]
    quota = rng.integers(0, 40, S) * rng.integers(0, 2, S)
    edge_p = np.array([p for p in range(P) for _ in member[p]])
    edge_s = np.array([s for m in member for s in m])
    flow = min_cost_flow(capacity, edge_p, edge_s, quota, repeats)
    sent = np.bincount(edge_p, flow, P).astype(int)
    cost = sum(int(np.clip(sent - r * capacity, 0, capacity).sum()) * (r * (r + 1) // 2) for r in range(repeats))
    assert (flow >= 0).all() and (np.bincount(edge_s, flow, S) <= quota).all() and (sent <= capacity * repeats).all()
    assert (int(sent.sum()), cost) == shortest_paths(capacity.tolist(), member, quota.tolist(), repeats)


def test_a_quota_of_many_times_its_source_is_met():
    flow = min_cost_flow(np.array([3, 10**9]), np.array([0, 1]), np.array([0, 1]), np.array([10**9, 5]))
    assert flow.tolist() == [10**9, 5]


def rows(n=400):
    out = [(i, f"text {i} " + "w " * (i % 13), "ab"[i % 2], "x") for i in range(n)]
    return out + [(n + i, out[i][1], "c", "x") for i in range(0, 40)]


def test_shares_and_repetition(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, mix_source string")
    out = mixture(df, {"a": 0.25, "b": 0.25, "c": 0.5}, total=2000, repeats=5).collect()
    got = {}
    for r in out:
        got[r.mix_source] = got.get(r.mix_source, 0) + 0
    n = {r.doc_id: len(r.text.split()) for r in out}
    assert len(n) == len(out)
    whole = sum(n[r.doc_id] * r.mix_repeats for r in out)
    assert abs(whole - 2000) < 120
    assert max(r.mix_repeats for r in out) > 1 and {r.mix_source for r in out} == {"a", "b", "c"}


def test_all_texts_once_when_wanted(spark):
    df = spark.createDataFrame(rows(60), "doc_id long, text string, source string, extra string")
    out = mixture(df, temperature=1.0, slots=4)
    assert out.columns == ["doc_id", "text", "source", "extra", "mix_source", "mix_repeats"]
    got = out.collect()
    assert abs(len(got) - 60) <= 3 and max(r.mix_repeats for r in got) <= 2


def test_awkward_rows(spark, awkward):
    out = mixture(awkward)
    got = [r.asDict() for r in out.collect()]
    assert all(r["text"] and r["text"].split() for r in got)
    assert len({r["text"] for r in got}) == len(got)
    assert mixture(awkward.where("false")).count() == 0
