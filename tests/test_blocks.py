"""What is quadratic by nature, in blocks: against brute force, and that its pairs aren't shuffled or interpreted."""

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.operators import decide, retrieval
from ridgeline.plans import catalog, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(4))
def test_a_documents_counts_by_decoding_each_offset(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    n = 40
    s = rng.integers(0, 60, n)
    e = s + rng.integers(0, 9, n)
    best, rejected = rng.normal(size=n).round(1), rng.normal(size=n).round(1)
    second = np.where(rng.random(n) < 0.2, np.nan, best - rng.random(n).round(1))
    hit = rng.integers(0, 2, n)
    point, want, last = rejected - best, [], (0, 0)
    for at in np.unique(point):
        on = np.flatnonzero(point <= at)
        w = best[on] - np.fmax(second[on], rejected[on] - np.nextafter(at, np.inf))
        keep = on[decide.schedule(s[on], e[on], np.maximum(w, 1e-300))]
        now = (int(hit[keep].sum()), keep.size)
        if now != last:
            want.append((at, now[0] - last[0], now[1] - last[1]))
            last = now
    monkeypatch.setattr(decide, "CELLS", 200)  # several blocks of offsets
    monkeypatch.setattr(decide, "schedule", None)  # it isn't called for each offset
    second = pa.array(second, pa.float64(), from_pandas=True)
    got = decide._steps(pa.table({"s": s, "e": e, "ty": hit, "best": best, "second": second, "rejected": rejected, "hit": hit}))
    assert [tuple(r.values()) for r in got.to_pylist()] == want != []


@pytest.mark.parametrize("skip_self", [False, True])
def test_reranked_by_brute_force(spark, monkeypatch, skip_self):
    monkeypatch.setattr(retrieval, "QUERIES", 7)  # several passes
    monkeypatch.setattr(retrieval, "KEY_RANGES", 5)
    v = np.random.default_rng(5).normal(size=(60, 6)).round(2)  # distances from 0 to 6: many ties
    table = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)] + [(1, None)], "id long, v array<double>").repartition(3)
    found = retrieval.Index(table, "id", "v", 6).search(table.where("id % 2 = 0"), 3, radius=16, oversample=4, skip_self=skip_self)
    want = []
    for q in range(0, 60, 2):
        d = ((v >= 0) != (v[q] >= 0)).sum(axis=1)
        near = [i for i in sorted(range(60), key=lambda i: (d[i], i)) if not (skip_self and i == q)][:12]
        top = sorted(near, key=lambda i: (-round(float(v[q] @ v[i]), 9), i))[:3]
        want += [(q * 3, i * 3, r + 1, int(d[i])) for r, i in enumerate(top)]
    assert sorted((r.qid, r.sid, r["rank"], r.distance) for r in found.collect()) == sorted(want)


def test_pairs_are_compared_in_compiled_code_and_stay_where_they_are(spark):
    plan = registry.queries()["hamming"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "lambda" not in plan
    plan = registry.queries()["topk_ann_rerank"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
