import numpy as np
import pytest

from ridgeline.functions import markup
from ridgeline.functions.normalize import fold_with_offsets, normalize
from ridgeline.operators import extract
from ridgeline.operators.matcher import Matcher
from ridgeline.operators.tokenizer import Tokenizer, raw_counts
from ridgeline.streaming import apply


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- extraction ---


def test_words(spark):
    got = rows(extract.word_spans(docs(spark, ["U.N. official", "", None, "ab cd12"])), "doc_id", "idx", "s", "e")
    assert got == [(0, 0, 0, 1), (0, 1, 2, 3), (0, 2, 5, 13), (3, 0, 0, 2), (3, 1, 3, 7)]


def test_named_patterns(spark):
    got = rows(extract.extract(docs(spark, ["UN 1996 x"]), [("caps", "[A-Z]+"), ("num", "[0-9]+"), (None, "[a-z]+")]), "s", "e", "ty")
    assert got == [(0, 2, 0), (3, 7, 1), (8, 9, 2)]


def test_shapes(spark):
    got = [r.ty for r in extract.shape_spans(docs(spark, ["U.N. McGrath's 1990s (why) & 1996 12 iPhone F1"])).orderBy("idx").collect()]
    assert [extract.SHAPE_NAMES[t] for t in got] == "u1 dot u1 dot icap apos low dsuf paren low paren amp d4 d2 alnum alnum".split()


# --- matching ---


def found(spark, patterns, texts, **options):
    m = Matcher.of(patterns, **{k: options.pop(k) for k in ("priorities", "normalize", "names") if k in options})
    return rows(m.predict(docs(spark, texts), **options), "doc_id", "id", "s", "e")


def test_matches(spark):
    assert found(spark, ["foo", "bar", "baz"], ["foo bar baz"]) == [(0, 0, 0, 3), (0, 1, 4, 7), (0, 2, 8, 11)]
    assert found(spark, ["cafe"], ["café", "café"], normalize=True) == [(0, 0, 0, 5), (1, 0, 0, 6)]
    assert found(spark, ["world"], ["héllo world"], normalize=True) == [(0, 0, 7, 12)]
    assert found(spark, ["ab", "abc"], ["abcd"]) == [(0, 0, 0, 2), (0, 1, 0, 3)]
    assert found(spark, ["new", "new york"], ["new york city"], longest=True) == [(0, 1, 0, 8)]
    assert found(spark, ["x", "x"], ["x"], priorities=[2, 1]) == [(0, 1, 0, 1)]
    assert found(spark, ["", "a"], ["", None, "a"]) == [(2, 1, 0, 1)]


def test_filters(spark):
    d = docs(spark, ["cat concatenate cat.", "cat"])
    tokens = spark.createDataFrame([(0, 0, 3), (0, 4, 15), (0, 16, 19), (1, 0, 3)], "doc_id long, s long, e long")
    m = Matcher.of(["cat"])
    assert m.predict(d).count() == 4
    assert rows(m.predict(d, tokens=tokens), "doc_id", "s", "e") == [(0, 0, 3), (0, 16, 19), (1, 0, 3)]
    assert rows(m.predict(d, exclude=[(0, 3)]), "doc_id", "s") == [(0, 7), (0, 16)]
    names = docs(spark, ["Alice and Unknown and Bob"])
    regions = [(0, 5), (10, 17), (21, 25)]
    assert Matcher.of(["Alice", "Bob"]).predict(names, exclude=regions).count() == 0
    assert rows(Matcher.of(["Alice", "Bob"]).exclude_hits(names, regions), "region", "hit") == [(0, 1), (1, 0), (2, 1)]
    # what is excluded no longer hides what is shorter
    assert found(spark, ["new york", "new"], ["new york"], longest=True, exclude=[(5, 6)]) == [(0, 1, 0, 3)]


@pytest.mark.parametrize("seed", range(5))
def test_matches_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    draw = lambda n: "".join(rng.choice(list("abé"), n))
    patterns = sorted({draw(int(rng.integers(1, 4))) for _ in range(6)})
    texts = [draw(int(rng.integers(0, 30))) for _ in range(8)]
    want = sorted((d, i, s, s + len(p.encode())) for d, t in enumerate(texts) for i, p in enumerate(patterns) for s in range(len(t.encode())) if t.encode()[s : s + len(p.encode())] == p.encode())
    assert found(spark, patterns, texts) == want


def test_tagging(spark):
    tag = lambda p, t, f, **o: Matcher.of(p, **o).tag(docs(spark, [t]), f).first().text
    assert tag(["foo", "bar"], "foo and bar", "[%match:%id]") == "[foo:0] and [bar:1]"
    assert tag(["x<y"], "x<y", "%match|%hmatch") == "x<y|x&lt;y"
    assert tag(["a"], "ba", "%%%name%%", names=["n&'"]) == "b%n&'%%"
    assert tag(["a"], "ba", "%hname", names=["n&'"]) == "bn&amp;&#39;"


# --- tokenizers ---


def counts(spark, texts, *args, **options):
    return [r.val for r in raw_counts(docs(spark, texts), *args, **options).collect()]


def test_raw_counts(spark):
    assert sum(counts(spark, ["hello"], 3, 3)) == 3
    assert sorted(counts(spark, ["ababab"], 2, 2)) == [2, 3]
    assert counts(spark, ["abc"], 2).__len__() == 5
    assert rows(raw_counts(docs(spark, ["a  b"]), 3, normalize=True), "gram", "val") == rows(raw_counts(docs(spark, ["a b"]), 3, normalize=True), "gram", "val")
    assert rows(raw_counts(docs(spark, ["a  b"]), 3), "gram", "val") != rows(raw_counts(docs(spark, ["a b"]), 3), "gram", "val")


TEXTS = ["Hello, wörld 42!", "a.b c-d  x", "", "  lead trail  ", "one"]


@pytest.mark.parametrize("options", [{"mode": "words"}, {"mode": "tags", "n_tags": 3}, {"mode": "chars"}, {"mode": "chars", "regions": True}, {"mode": "flat", "terminals": True}])
def test_fit_and_transform_agree(spark, options):
    d = docs(spark, TEXTS)
    tokens = extract.word_spans(d).selectExpr("doc_id", "s", "e", "cast(idx % 5 - 1 as int) AS ty")
    focus = spark.createDataFrame([(0, 0, 2, 9), (1, 0, 1, 3), (1, 1, 4, 9), (3, 0, 3, 8), (4, 0, 0, 3)], "doc_id long, idx long, s long, e long")
    t = Tokenizer(3, focus=True, **options)
    f = t.fit(d, tokens, focus)
    x = f.transform(d, tokens, focus)
    assert x.select("doc_id", "idx").distinct().count() == 5
    assert sum(r.val for r in x.collect()) == sum(r.val for r in t.rows(d, tokens, focus).collect())
    assert [r.col for r in f.vocab.orderBy("gram").collect()] == list(range(f.n_tokens()))
    assert f.group_offsets() is None if not t.regions else f.group_offsets()[-1] == f.n_tokens()


def test_errors(spark):
    for bad in ({"mode": "tags"}, {"mode": "flat", "normalize": True}, {"mode": "tags", "n_tags": 3, "normalize": True}, {"ngram_min": 3}, {"regions": True}, {"mode": "no"}):
        with pytest.raises(ValueError):
            Tokenizer(2, **bad)
    with pytest.raises(ValueError):
        Tokenizer(2, mode="flat").fit(docs(spark, ["a"]))


def test_streams_give_what_tables_give(spark, tmp_path):
    d = docs(spark, TEXTS)
    d.write.parquet(str(tmp_path / "in"))
    f = Tokenizer(2).fit(d)
    stream = apply.tokenize(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), f)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("doc_id", "explode(arrays_zip(cols, vals)) AS p").selectExpr("doc_id", "p.cols AS col", "p.vals AS val")
    assert rows(got, "doc_id", "col", "val") == rows(f.transform(d), "doc_id", "col", "val")
    with pytest.raises(ValueError):
        apply.tokenize(d, f, most=3)


# --- normalisation ---


def test_normalize():
    assert normalize("  Äpfel\tund\nStraße—“Ünïcode” ") == 'apfel und strase-"unicode"'
    # small Greek letters up to omicron come out as the next one's letter: the tables to be matched have them so
    assert normalize("Жукова θεσι έ Œuvre ｆｕｌｌ") == "zhukova thzsk έ oeuvre full"
    raw, start, end = fold_with_offsets("aÆb")
    assert raw == b"aaeb" and start.tolist() == [0, 1, 1, 3] and end.tolist() == [1, 3, 3, 4]


# --- markup ---


def test_html(spark):
    one = spark.createDataFrame([("<p>hello</p> <b>world</b>",), ("before<script>var x=1;</script>after<style>.a{}</style>end",), ("a<!-- comment -->b",), (None,), (" <p>\n<b> x</b>y</p> ",)], "html string")
    assert [r[0] for r in one.select(markup.html_text(one.html)).collect()] == [["hello", " world"], ["before", "after", "end"], ["a", "b"], None, [" \n x", "y"]]
    text, tags = markup.extract('hello <span class="author">John</span> world')
    assert text == "hello John world" and len(tags) == 1 and tags[0]["attrs"] == {"class": "author"} and text[tags[0]["s"] - 1 : tags[0]["e"]] == "John"
    assert markup.inject(text, tags) == 'hello <span class="author">John</span> world'
    text, tags = markup.extract('<span class="title">BOOK</span> by <span class="author">Smith</span>')
    assert text == "BOOK by Smith" and [t["attrs"]["class"] for t in tags] == ["title", "author"]
    assert markup.inject("hello Germany world", [{"name": "span", "s": 7, "e": 13, "attrs": {"id": "276", "data-x": "1", "class": "country"}, "text": None}], ["class", "id"]) == 'hello <span class="country" id="276" data-x="1">Germany</span> world'
    text, tags = markup.extract('<span class="author">J. Smith</span>')
    tags[0]["text"] = "John Smith"
    assert markup.inject(text, tags) == '<span class="author">John Smith</span>'
    assert [t["name"] for t in markup.extract('<b>bold</b> and <i x="1">italic</i>')[1]] == ["b", "i"]
    assert markup.match_tags([(10, 0, 4), (20, 8, 15)], {10: "alpha", 20: "beta"}, "pred ")[1] == {"name": "span", "s": 9, "e": 15, "attrs": {"class": "pred beta"}, "text": None}
    assert markup.match_tags([(5, 2, 7)])[0]["attrs"]["class"] == "5"


def test_nested_tags_come_back():
    for h in ("<div><p>a <b>b</b></p><p>c</p></div>", "<ul><li>x</li><li>yé</li></ul>", "t<i>u<b>v</b></i>w"):
        assert markup.inject(*markup.extract(h)) == h


def test_json():
    assert markup.json_fields('{"a":"yes","nested":{"a":"no"},"b":"also"}', ["a", "b"]) == ["yes", "also"]
    assert markup.json_fields(r'{"val":"hello\"world"}', ["val"]) == [r"hello\"world"]
    assert markup.json_fields('{"a":"","b":"ok","c":["x","y"],"d":1}', ["a", "b", "c", "d"]) == ["ok", "x", "y"]
    assert markup.json_fields("", ["a"]) == []
