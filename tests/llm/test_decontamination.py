import random
from collections import Counter

import numpy as np
import pyarrow as pa

from ridgeline.llm import decontamination as dc
from ridgeline.llm.common import shingles, text_buffer, words

R = random.Random(4)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


ITEMS = [" ".join(prose(n, 100 + n)) for n in (6, 12, 20, 33, 50, 80, 150)]


def documents():
    rows = []
    for i, item in enumerate(ITEMS):
        for k, n in enumerate((0, 40, 400)):
            rows.append((i * 10 + k, " ".join(prose(n, i * 7 + k) + item.upper().split() + prose(n, i * 9 + k)), i))
        w = item.split()
        if len(w) >= 20:
            w[len(w) // 3] = "changed"
            rows.append((i * 10 + 5, " ".join(prose(100, i) + w + prose(30, i + 1)), i))
    return rows + [(1000 + j, " ".join(prose(200, 5000 + j)), None) for j in range(20)]


def test_planted_items_are_found_and_no_others(spark):
    rows = documents()
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.contamination(docs, bench).collect()}
    assert set(got) == {(d, i) for d, _, i in rows if i is not None}
    assert all(s == 1 for (d, _), s in got.items() if d % 10 < 3)
    again = {(r.doc_id, r.item_id): r.similarity for r in dc.contamination(docs, bench, items=2).collect()}
    assert again == got


def brute(item, text):
    """The best weighted share over all stretches of the item's length with its margins."""
    pairs = lambda t: Counter(zip(t.split(), t.split()[1:]))
    own, words_ = pairs(item), text.split()
    size = dc.size_class(len(item.split()) - 1)
    long = size + 2 * max(1, size // 7)
    weight = lambda p: len(p[0]) + len(p[1])
    total = sum(n * weight(p) for p, n in own.items())
    best = 0
    for at in range(max(1, len(words_) - long)):
        there = Counter(zip(words_[at : at + long], words_[at + 1 : at + long + 1]))
        best = max(best, sum(min(n, there[p]) * weight(p) for p, n in own.items()))
    return best / total


def test_edited_items_are_found_as_by_brute_force(spark):
    r = random.Random(77)
    items = [" ".join(prose(n, 300 + 10 * n + k)) for n in (30, 60, 120) for k in range(4)]
    rows = []
    for i, item in enumerate(items):
        for share in (0.1, 0.15, 0.2):
            for k in range(2):
                w = item.split()
                for j in r.sample(range(len(w)), round(share * len(w))):
                    w[j] = "edit" + str(r.randrange(10**6))
                rows.append((len(rows), " ".join(prose(r.randrange(60), len(rows)) + w + prose(50, 1000 + len(rows)))))
    want = {(d, i): s for d, t in rows for i, item in enumerate(items) if (s := brute(item, t)) >= 0.6}
    assert len(want) > len(rows) / 2
    got = dc.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): x.similarity for x in got} == {k: round(s, 6) for k, s in want.items()}


def test_index_finds_all_fingerprints_within_the_radius():
    data, offsets = text_buffer(pa.array(ITEMS, pa.large_string()))
    index = dc.Index(np.arange(len(ITEMS)), data, offsets, 15)
    rng = np.random.default_rng(0)
    for size, _ in index.classes.items():
        own = [i for i in range(len(ITEMS)) if dc.size_class(len(ITEMS[i].split()) - 1) == size]
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 25), replace=False)) for _ in range(400)], np.uint64)
        prints = index.prints[own[0]] ^ flips
        w, i = index.within(size, prints)
        want = {(a, b) for a in range(400) for b in own if bin(int(prints[a] ^ index.prints[b])).count("1") <= 15}
        assert set(zip(w.tolist(), i.tolist())) == want


def test_fingerprints_are_majorities():
    h, _, _, at = words(*text_buffer(pa.array([" ".join(prose(700, 3))], pa.large_string())))
    sh, so = shingles(h, at, 2)
    for size in (5, 60, 300):
        start, end, _ = dc.windows(so, size)
        got = dc.Planes(sh, size).fingerprints(start, end)
        for k in range(0, start.size, 7):
            part = sh[start[k] : end[k]]
            want = sum(1 << b for b in range(64) if 2 * sum((int(x) >> b) & 1 for x in part) > part.size)
            assert int(got[k]) == want


def test_awkward_rows(spark, awkward):
    bench = spark.createDataFrame([(1, "the same text over and over again for all to see", 1), (1, "the same text over and over again for all to see", 1), (2, None, 1), (None, "nobody can name this text of a few words", 1), (3, "", 1), (4, "one", 1)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id) for r in dc.contamination(awkward, bench).collect()}
    assert got == {(1, 1), (2, 1), (6, 4)}
    assert dc.contamination(awkward.where("false"), bench).count() == 0
    assert dc.contamination(awkward, bench.where("false")).count() == 0
