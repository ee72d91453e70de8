"""What is worked out within one pass over texts against the operators on tables, and how much leaves the pass."""

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.operators import passes, spans
from ridgeline.operators.gazetteer import Gazetteer
from ridgeline.operators.tokenizer import Tokenizer
from ridgeline.plans import catalog, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


def drawn(rng, n):
    s = rng.integers(0, 12, n)
    return passes.of(s, s + rng.integers(1, 5, n), rng.integers(0, 3, n))


def table(spark, sets):
    rows = [(d, *map(int, r)) for d, x in enumerate(sets) for r in zip(x.idx, x.s, x.e, x.ty)]
    return spark.createDataFrame(rows, "doc_id long, idx int, s long, e long, ty int")


def test_span_sets_of_a_text_are_like_tables_of_spans(spark):
    rng = np.random.default_rng(3)
    gold, gaz, bio = ([drawn(rng, int(rng.integers(0, 7))) for _ in range(60)] for _ in range(3))
    g, a, b = (table(spark, x).cache() for x in (gold, gaz, bio))
    total = sum((passes.misses(*x) for x in zip(gold, gaz, bio)), passes.Counter())
    assert dict(total) == {tuple(r)[:4]: r.n for r in spans.miss_report(g, a, b).collect()}

    def rows(df, *columns):
        return sorted(tuple(r[c] for c in columns) for r in df.collect())

    def here(of):
        return sorted((d, i, v) for d, x in enumerate(zip(gold, gaz)) for i, v in enumerate(of(*x).tolist()))

    assert here(lambda x, o: passes.first_types(x, o, 9)) == rows(spans.types_of(g, a, 9), "doc_id", "idx", "label")
    assert here(passes.within) == rows(spans.contained(g, a), "doc_id", "idx", "inside")
    assert [(d, i) for d, i, ok in here(passes.aligned) if ok] == rows(spans.aligned(g, a), "doc_id", "idx")
    longest = sorted((d, int(i)) for d, x in enumerate(gold) for i in passes.longest(x.s, x.e, x.idx))
    assert longest == rows(spans.longest(g.withColumnRenamed("idx", "id")), "doc_id", "id")


def test_words_and_listed_ones():
    text = "The Ünd und, THE end AND2 and".encode()
    w = passes.words(text)
    assert [text[a:b] for a, b in zip(w.s, w.e)] == [b"The", b"nd", b"und", b"THE", b"end", b"AND2", b"and"]
    x = passes.listed(text, w, {b"the": 0, b"und": 1, b"and": 2, b"no": 3})
    assert x.idx.tolist() == [0, 2, 3, 6] and x.ty.tolist() == [0, 1, 0, 2]
    assert passes.words(b"").s.size == 0 and passes.listed(b"", passes.words(b""), {b"a": 1}).s.size == 0


@pytest.mark.parametrize("name", ["span_longest", "win_span_nms", "join_type_labels", "filt_token_align", "span_contained", "win_bio_to_spans", "tok_flat", "tok_tags", "tok_words_of_spans", "aho_tokens"])
def test_no_span_is_shuffled(spark, name):
    assert "Exchange" not in registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["join_miss_report", "seg_ceiling", "agg_surface_gaz", "agg_gaz_block", "agg_gaz_block_char"])
def test_spans_are_not_ordered_or_joined_as_rows(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_what_leaves_a_pass_is_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["id"])
    sizes = np.random.default_rng(0).integers(0, 3000, 1000)
    out = list(passes.bounded(batch, [0], ([np.arange(n), np.ones(n, np.int64)] for n in sizes), ["id", "a", "b"], [pa.int64(), pa.float32()]))
    assert len(out) > 10 and max(b.num_rows for b in out) < passes.ROWS + 3000
    t = pa.Table.from_batches(out)
    assert t.num_rows == sizes.sum() and t.column("id").to_pylist() == np.repeat(np.arange(1000), sizes).tolist()
    assert not list(passes.bounded(batch.slice(0, 0), [0], (), ["id", "a", "b"], [pa.int64(), pa.float32()]))


def test_tokens_found_in_the_pass_are_like_given_ones(spark):
    d = spark.createDataFrame([(0, "ab cd ef"), (1, None), (2, ""), (3, "x"), (None, "the and")], "doc_id long, text string")
    given = passes.each(d, lambda text, known: [(w := passes.words(text)).s, w.e], "s long, e long")
    for t in (Tokenizer(2, mode="flat"), Tokenizer(2, mode="words")):
        got, want = (sorted(map(tuple, t.rows(d.where("doc_id IS NOT NULL"), x).collect())) for x in ("words", given))
        assert got == want


def test_long_gazetteers_are_joined(spark, monkeypatch):
    from ridgeline.operators import gazetteer
    from ridgeline.plans import spans as plans

    d = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    z = Gazetteer.found(d, plans._gold, 4, (2, 3))
    rows = lambda df: sorted((r.doc_id, r.s, r.e, r.col, round(r.val, 9)) for r in df.collect())
    sent = rows(z.block_found(d, plans._labelled_short))
    monkeypatch.setattr(gazetteer, "MOST_SENT", 3)
    assert rows(z.block_found(d, plans._labelled_short)) == sent != []
