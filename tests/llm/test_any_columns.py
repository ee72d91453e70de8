"""Every operator and stage over tables whose other columns have hostile names and types."""

import corpus_pipeline
import pytest

from ridgeline.llm import ann, decontamination, html_extraction, lm_scoring, mixing, near_dedup, quality, substring_dedup, token_counts, url_filters

HOSTILE = "_c0 _c1 _c2 _cid _cs _h1 _h2 _id _id_ _t _cuts text_hash _keep_ _low row rank a b c id key doc pos pair score keep n_words kept_id group_size n count similarity item_id component label first last hash shared unit q v s".split()
LONG = " ".join(f"long{i % 700}" for i in range(4000))


def widened(df):
    for c in HOSTILE:
        if c not in df.columns:
            df = df.selectExpr("*", f"concat('x', '{c}') AS `{c}`")
    return df.selectExpr("*", "map('k', 1) AS `a map`", "named_struct('x', 1) AS `a.dot`")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    words = [" ".join(f"w{(i * 7 + j * j) % 97}" for j in range(70)) for i in range(12)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(words)]
    rows += [(20, words[0], "en", "b", 1), (20, words[0], "en", "b", 1), (21, words[1] + " " + words[2], "en", None, 1), (22, None, None, "a", None), (23, "", "en", "a", 0), (24, LONG, "en", "a", 9), (25, LONG, "en", "a", 9), (None, words[3], "en", "a", 1), (3, "a second text under a number that was given before", "en", "a", 1)]
    docs = widened(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    labels = widened(spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int"))
    bench = widened(spark.createDataFrame([(1, " ".join(words[5].split()[:30])), (None, "x y z"), (2, None), (3, "")], "item_id long, text string"))
    pages = widened(spark.createDataFrame([(i, f"http://h{i % 3}.org/en/{i}" + "/x" * (900 if i == 7 else 0), f"<p>{t}</p><div>menu</div>") for i, t in enumerate(words)] + [(None, None, None), (50, "", "")], "page_id long, url string, html string"))
    vectors = widened(spark.createDataFrame([(i, [float((i * j) % 5) for j in range(1, 9)]) for i in range(40)] + [(41, None), (None, [1.0] * 8)], "vec_id long, embedding array<float>"))
    path = str(tmp_path_factory.mktemp("any"))
    labels.write.parquet(f"{path}/labels.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    return docs, labels, bench, pages, vectors, path


def plain(df):
    return sorted(map(str, df.collect()))


def test_operators_read_only_their_own_columns(tables):
    docs, labels, bench, pages, vectors, _ = tables
    d, y, b, p, v = docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"), bench.select("item_id", "text"), pages.select("page_id", "url", "html"), vectors.select("vec_id", "embedding")
    tokenizer = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    for f, wide, narrow in (
        (lambda x: token_counts.token_counts(x, tokenizer), (docs,), (d,)),
        (html_extraction.extract, (pages, docs), (p, d)),
        (decontamination.contamination, (docs, bench), (d, b)),
        (ann.neighbours, (vectors,), (v,)),
        (substring_dedup.repeated_passages, (docs,), (d,)),
        (quality.quality_scores, (docs, labels), (d, y)),
        (lm_scoring.cross_entropy_difference, (docs, labels), (d, y)),
        (near_dedup.near_duplicates, (docs,), (d,)),
        (url_filters.url_filter, (pages, labels), (p, y)),
    ):
        assert plain(f(*wide)) == plain(f(*narrow))
    chosen = mixing.mixture(docs)
    assert chosen.columns == [*docs.columns, "mix_source", "mix_repeats"]
    assert plain(chosen.select("doc_id", "text", "mix_source", "mix_repeats")) == plain(mixing.mixture(d).select("doc_id", "text", "mix_source", "mix_repeats"))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_any_columns(spark, tables, stage):
    docs, *_, path = tables
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, path)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r["a map"] == {"k": 1} and r["a.dot"].x == 1 and r["_cuts"] == "x_cuts" and r["text_hash"] == "xtext_hash" for r in rows)
