"""Queries of tokenizers, extraction, matching and markup."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import markup
from ridgeline.functions.normalize import normalized
from ridgeline.operators import extract, passes, tokenizer
from ridgeline.operators.matcher import Matcher
from ridgeline.operators.tokenizer import Tokenizer
from ridgeline.plans import _sql
from ridgeline.plans.registry import query

PATTERNS = ["th", "the", "and", "en", "ung", "der"]
_HEX = "h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)"
_SCRUBBED = r"regexp_replace(coalesce(text, ''), '[\x01-\x08\x0e-\x1f\x7f]', ' ', 'g')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")


# --- tokenizers ---


@query("tok_raw", f"WITH {_HEX}, g AS ({_sql.grams('h', 'h', 3)}) SELECT doc_id, {_sql.number('x')} AS gram, count(*)::FLOAT AS val FROM g GROUP BY ALL")
def tok_raw(spark, sf_dir):
    return tokenizer.raw_counts(docs(spark, sf_dir), 3, 3)


@query("agg_ngram_count", f"WITH {_HEX}, g AS ({_sql.grams('h', 'h', 1)} UNION ALL {_sql.grams('h', 'h', 2)}) SELECT doc_id, {_sql.number('x')} AS gram, count(*)::FLOAT AS val FROM g GROUP BY ALL")
def agg_ngram_count(spark, sf_dir):
    return tokenizer.raw_counts(docs(spark, sf_dir), 2)


_VOCAB = f"WITH h AS (SELECT doc_id, lang, hex(encode({_SCRUBBED})) AS h FROM documents), g AS ({_sql.grams('h', 'h', 2, ', lang')}), v AS (SELECT gram, (row_number() OVER (ORDER BY gram) - 1)::INT AS col FROM (SELECT DISTINCT {_sql.number('x')} AS gram FROM g"


@query("tok_fit", f"{_VOCAB})) SELECT gram, col FROM v")
def tok_fit(spark, sf_dir):
    """Vocabulary of byte bigrams, numbered in the order of their keys."""
    return Tokenizer(2, 2).fit(docs(spark, sf_dir)).vocab


@query("tok_tokenize", f"{_VOCAB})) SELECT doc_id, 0::BIGINT AS idx, col, count(*)::FLOAT AS val FROM g JOIN v ON {_sql.number('x')} = gram GROUP BY ALL")
def tok_tokenize(spark, sf_dir):
    d = docs(spark, sf_dir)
    return Tokenizer(2, 2).fit(d).transform(d)


@query("filt_frozen_vocab", f"{_VOCAB} WHERE lang = 'de')) SELECT doc_id, 0::BIGINT AS idx, col, count(*)::FLOAT AS val FROM g JOIN v ON {_sql.number('x')} = gram GROUP BY ALL")
def filt_frozen_vocab(spark, sf_dir):
    """A vocabulary learned from German documents, applied to all."""
    d = docs(spark, sf_dir)
    return Tokenizer(2, 2).fit(d.where("lang = 'de'")).transform(d)


@query("tok_n_tokens", f"{_VOCAB})) SELECT count(*) AS n FROM v")
def tok_n_tokens(spark, sf_dir):
    return Tokenizer(2, 2).fit(docs(spark, sf_dir)).vocab.agg(F.count("*").alias("n"))


@query("tok_flat", f"WITH h AS (SELECT doc_id, hex(encode(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', chr(1), 'g'))) AS h FROM documents), g AS ({_sql.grams('h', 'h', 3)}) SELECT doc_id, 0::BIGINT AS idx, {_sql.number('x')} AS gram, count(*)::FLOAT AS val FROM g GROUP BY ALL")
def tok_flat(spark, sf_dir):
    return Tokenizer(3, 3, mode="flat").rows(docs(spark, sf_dir), "words")


_HASH = "list_reduce(list_prepend(0::UHUGEINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::UHUGEINT)), lambda h, x: (h * 11400714819323198485::UHUGEINT + x) % 18446744073709551616::UHUGEINT)"
_SIGNED = "(CASE WHEN {0} >= 9223372036854775808::UHUGEINT THEN {0}::HUGEINT - 18446744073709551616::HUGEINT ELSE {0}::HUGEINT END)::BIGINT"
_HASHED = f"{_sql.RUNS}, u AS (SELECT t, {_HASH} AS h FROM (SELECT DISTINCT t FROM w))"


@query("tok_words", f"WITH {_HASHED} SELECT doc_id, 0::BIGINT AS idx, {_SIGNED.format('h')} AS gram, count(*)::FLOAT AS val FROM w JOIN u USING (t) GROUP BY ALL")
def tok_words(spark, sf_dir):
    """Word unigrams of each document: 64-bit rolling hashes."""
    return Tokenizer(1, mode="words").rows(docs(spark, sf_dir), "words")


@query("tok_word_bigrams", f"WITH {_HASHED}, b AS (SELECT doc_id, idx, h, lead(h) OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM w JOIN u USING (t)), k AS (SELECT doc_id, (h * 11400714819323198485::UHUGEINT + n) % 18446744073709551616::UHUGEINT AS h FROM b WHERE n IS NOT NULL) SELECT doc_id, 0::BIGINT AS idx, {_SIGNED.format('h')} AS gram, count(*)::FLOAT AS val FROM k GROUP BY ALL")
def tok_word_bigrams(spark, sf_dir):
    """Word bigrams of each document. Some pairs of words share a key, which is a sum."""
    return Tokenizer(2, 2, mode="words").rows(docs(spark, sf_dir), "words")


@query("tok_words_of_spans", f"WITH {_HASHED} SELECT doc_id, 0::BIGINT AS idx, {_SIGNED.format('h')} AS gram, count(*)::FLOAT AS val FROM w JOIN u USING (t) WHERE e - s >= 4 GROUP BY ALL")
def tok_words_of_spans(spark, sf_dir):
    """Word unigrams of given tokens: words of four bytes or more."""
    long = lambda text: [t for t in tokenizer.word_tokens(text) if t[1] - t[0] >= 4]
    return Tokenizer(1, mode="words").rows(docs(spark, sf_dir), long)


_POWERS = [pow(tokenizer.BASE, 8 - i, 1 << 64) for i in range(9)]
_NINE = " + ".join(f"b[i + {i}] * {c}::HUGEINT" for i, c in enumerate(_POWERS))


@query("tok_long_grams", f"WITH {_HEX}, b AS (SELECT doc_id, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::HUGEINT) AS b FROM h), g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(b) - 7, 1)), lambda i: ({_NINE}) % 18446744073709551616::HUGEINT)) AS x FROM b) SELECT doc_id, (CASE WHEN x >= 9223372036854775808::HUGEINT THEN x - 18446744073709551616::HUGEINT ELSE x END)::BIGINT AS gram, count(*)::FLOAT AS val FROM g GROUP BY ALL")
def tok_long_grams(spark, sf_dir):
    """Byte n-grams of nine bytes, which are too long to pack: rolling hashes."""
    return tokenizer.raw_counts(docs(spark, sf_dir), 9, 9)


_SHAPE_CASE = " ".join(
    f"WHEN regexp_matches(t, '^(?:{p})$') THEN {i}"
    for i, p in enumerate(["[A-Z]{2,}", "[A-Z][a-z]+[A-Z][A-Za-z]*", "[A-Z][a-z]+", "[A-Z]", "[a-z]+", "[0-9]{4}", "[0-9]{2}", "[0-9]+", "[0-9]+[a-z]+", "[A-Za-z0-9]+", r"[.]+", ",+", "-+", "''+", '["`]+', "[()]+", "&+", "/+"])
)
_SHAPES = rf"""p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+') AS ps FROM documents),
q AS (SELECT doc_id, generate_subscripts(ps, 1) AS k, unnest(ps) AS t FROM p),
r AS (SELECT doc_id, k, t, octet_length(encode(t)) AS n, sum(octet_length(encode(t))) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM q),
sh AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS idx, (e - n)::BIGINT AS s, e::BIGINT AS e, (CASE {_SHAPE_CASE} ELSE 18 END)::INT AS ty FROM r WHERE NOT regexp_matches(t, '^[ \t\n\r\x0b\x0c]'))"""


@query("tok_tags", f"WITH {_SHAPES}, g AS (SELECT doc_id, ty + 1 AS a, lead(ty) OVER (PARTITION BY doc_id ORDER BY idx) + 1 AS b FROM sh) SELECT doc_id, 0::BIGINT AS idx, (a * 256 + b)::BIGINT AS gram, count(*)::FLOAT AS val FROM g WHERE b IS NOT NULL GROUP BY ALL")
def tok_tags(spark, sf_dir):
    """Bigrams of shape tags."""
    return Tokenizer(2, 2, mode="tags", n_tags=len(extract.SHAPES)).rows(docs(spark, sf_dir), extract.finder(extract.SHAPES))


_FOCUS = f"""{_sql.RUNS}, f AS (SELECT doc_id, s, e FROM w QUALIFY idx = least(3, max(idx) OVER (PARTITION BY doc_id))),
d AS (SELECT doc_id, hex(encode({_SCRUBBED})) AS h FROM documents),
h AS (SELECT doc_id, s, e, regexp_extract_all(substr(h, 1, 2 * s) || '01' || substr(h, 2 * s + 1, 2 * (e - s)) || '02' || substr(h, 2 * e + 1), '..') AS b FROM d JOIN f USING (doc_id)),
g AS (SELECT doc_id, s AS o, e + 1 AS c, unnest(list_transform(range(1, greatest(len(b) - 1, 1)), lambda i: {{'i': i - 1, 'x': b[i] || b[i + 1] || b[i + 2]}})) AS u FROM h),
k AS (SELECT doc_id, {_sql.number("u.x")} AS gram, CASE WHEN u.i + 3 <= o THEN 0 WHEN u.i <= o THEN 1 WHEN u.i + 3 <= c THEN 2 WHEN u.i <= c THEN 3 ELSE 4 END AS r FROM g)"""


def _focus(d: DataFrame) -> DataFrame:
    def fourth(text, known):
        w = passes.words(text)
        w = w.at(w.idx == min(3, w.s.size - 1))
        return [np.zeros(w.s.size), w.s, w.e]

    return passes.each(d, fourth, "idx long, s long, e long")


@query("tok_focus", f"WITH {_FOCUS} SELECT doc_id, 0::BIGINT AS idx, gram, count(*)::FLOAT AS val FROM k GROUP BY ALL")
def tok_focus(spark, sf_dir):
    """Byte trigrams of documents with marks around their fourth word, or their last one if there are fewer."""
    d = docs(spark, sf_dir)
    return Tokenizer(3, 3, focus=True).rows(d, focus=_focus(d))


@query("tok_regions", f"WITH {_FOCUS} SELECT doc_id, 0::BIGINT AS idx, gram + r * (1::BIGINT << 60) AS gram, count(*)::FLOAT AS val FROM k GROUP BY ALL")
def tok_regions(spark, sf_dir):
    d = docs(spark, sf_dir)
    return Tokenizer(3, 3, focus=True, regions=True).rows(d, focus=_focus(d))


@query("agg_group_offsets", f"WITH {_FOCUS}, n AS (SELECT r, count(DISTINCT gram) AS n FROM k GROUP BY r) SELECT r::BIGINT AS region, n FROM n")
def agg_group_offsets(spark, sf_dir):
    """Vocabulary size of each region of the focus."""
    d = docs(spark, sf_dir)
    v = Tokenizer(3, 3, focus=True, regions=True).fit(d, focus=_focus(d)).vocab
    return v.groupBy(F.shiftrightunsigned("gram", 60).alias("region")).agg(F.count("*").alias("n"))


@query("norm_text")
def norm_text(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", normalized(F.col("text")).alias("text"))


@query("tok_normalized")
def tok_normalized(spark, sf_dir):
    return Tokenizer(3, 3, normalize=True).rows(docs(spark, sf_dir))


# --- extraction ---


@query("word_spans", f"WITH {_sql.RUNS} SELECT doc_id, idx, s, e FROM w")
def word_spans(spark, sf_dir):
    return extract.word_spans(docs(spark, sf_dir))


@query("shape_spans", f"WITH {_SHAPES} SELECT doc_id, idx, s, e, ty FROM sh")
def shape_spans(spark, sf_dir):
    return extract.shape_spans(docs(spark, sf_dir))


@query("extract", f"WITH {_sql.RUNS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INT AS idx, s, e, (CASE WHEN regexp_matches(t, '^[A-Z]') THEN 0 ELSE 1 END)::INT AS ty FROM w WHERE regexp_matches(t, '^[A-Z]|^[a-z]')")
def extract_(spark, sf_dir):
    """Words that begin with a capital or, without a name, with a small letter."""
    return extract.extract(docs(spark, sf_dir), [("capital", "(?<![A-Za-z0-9])[A-Z][A-Za-z0-9]*"), (None, "(?<![A-Za-z0-9])[a-z][A-Za-z0-9]*")])


# --- matching ---

_PATTERNS = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PATTERNS))
#: None of the patterns overlaps itself, so a text's pieces between them tell where they are.
_MATCHES = f"""pat AS (SELECT * FROM (VALUES {_PATTERNS}) v(id, x)),
cut AS (SELECT doc_id, id, x, string_split(text, x) AS t FROM documents, pat WHERE text IS NOT NULL),
piece AS (SELECT doc_id, id, x, len(t) AS n, generate_subscripts(t, 1) AS k, unnest(t) AS t FROM cut),
m AS (SELECT doc_id, id::BIGINT AS id, (e - length(x))::BIGINT AS s, e::BIGINT AS e FROM (SELECT *, sum(octet_length(encode(t)) + length(x)) OVER (PARTITION BY doc_id, id ORDER BY k) AS e FROM piece) WHERE k < n)"""


@query("aho_predict", f"WITH {_MATCHES} SELECT doc_id, id, s, e FROM m")
def aho_predict(spark, sf_dir):
    return Matcher.of(PATTERNS).predict(docs(spark, sf_dir)).drop("idx")


@query("aho_tokens", f"WITH {_MATCHES}, {_sql.RUNS} SELECT doc_id, id, s, e FROM m SEMI JOIN w USING (doc_id, s) WHERE (doc_id, e) IN (SELECT (doc_id, e) FROM w)")
def aho_tokens(spark, sf_dir):
    """Matches that begin and end with words."""
    return Matcher.of(PATTERNS).predict(docs(spark, sf_dir), tokens="words").drop("idx")


@query("aho_exclude", f"WITH {_MATCHES} SELECT doc_id, id, s, e FROM m WHERE NOT (s < 200 AND e > 50) AND NOT (s < 400 AND e > 300)")
def aho_exclude(spark, sf_dir):
    return Matcher.of(PATTERNS).predict(docs(spark, sf_dir), exclude=[(50, 200), (300, 400)]).drop("idx")


@query("aho_exclude_hits", f"WITH {_MATCHES}, r AS (SELECT * FROM (VALUES (0, 50, 200), (1, 100, 180), (2, 300, 400)) v(region, lo, hi)), f AS (SELECT doc_id, id, s, min(region) AS region FROM m JOIN r ON s < hi AND e > lo GROUP BY ALL) SELECT region::INT AS region, (region IN (SELECT region FROM f))::INT AS hit FROM r")
def aho_exclude_hits(spark, sf_dir):
    return Matcher.of(PATTERNS).exclude_hits(docs(spark, sf_dir), [(50, 200), (100, 180), (300, 400)])


@query("win_longest_match")
def win_longest_match(spark, sf_dir):
    return Matcher.of(PATTERNS).predict(docs(spark, sf_dir), longest=True)


@query("aho_normalized")
def aho_normalized(spark, sf_dir):
    return Matcher.of(["heitung", "schon", "entonces", "the"], normalize=True).predict(docs(spark, sf_dir))


@query("aho_tag", "SELECT doc_id, replace(text, 'sch', '<b id=0>sch</b>') AS text FROM documents")
def aho_tag(spark, sf_dir):
    return Matcher.of(["sch"]).tag(docs(spark, sf_dir), "<b id=%id>%hmatch</b>")


@query("aho_states", "SELECT 15::BIGINT AS n_states")
def aho_states(spark, sf_dir):
    return spark.createDataFrame([(Matcher.of(PATTERNS).n_states(),)], "n_states long")


@query("match_tags", f"WITH {_MATCHES} SELECT doc_id, 'span' AS name, s + 1 AS s, e, 'm-' || CASE id WHEN 1 THEN 'article' ELSE id::VARCHAR END AS class FROM m")
def match_tags(spark, sf_dir):
    """Matches as tags of their text."""
    return markup.tags_of_matches(Matcher.of(PATTERNS).predict(docs(spark, sf_dir)), {1: "article"}, "m-")


# --- markup ---

#: Pages cut at "<": the first ">" ends a tag, but for comments and what stands in scripts and styles.
_NODES = r"""c AS (SELECT page_id, unnest(string_split(html, '<')) AS x, generate_subscripts(string_split(html, '<'), 1) AS k FROM pages WHERE html IS NOT NULL),
o AS (SELECT *, k > 1 AND regexp_matches(lower(x), '^(script|style)([^a-z0-9]|$)') AS raw_on, k > 1 AND regexp_matches(lower(x), '^/(script|style)[^a-z0-9]') AS raw_off, k > 1 AND starts_with(x, '!--') AS note_on, strpos(x, '-->') > 0 AS note_off FROM c),
st AS (SELECT *, max(CASE WHEN raw_on THEN k ELSE 0 END) OVER w AS r1, max(CASE WHEN raw_off THEN k ELSE 0 END) OVER w AS r0, max(CASE WHEN note_on THEN k ELSE 0 END) OVER w AS n1, max(CASE WHEN note_off THEN k ELSE 0 END) OVER w AS n0 FROM o WINDOW w AS (PARTITION BY page_id ORDER BY k)),
nd AS (SELECT page_id, k, CASE WHEN k = 1 THEN x WHEN r1 > r0 THEN '' WHEN n1 > n0 THEN '' WHEN n1 > 0 AND n0 = k THEN substr(x, strpos(x, '-->') + 3) ELSE substr(x, strpos(x, '>') + 1) END AS t FROM st),
gr AS (SELECT *, regexp_matches(t, '[^ \t\n\r\f\x0b]') AS filled, sum(regexp_matches(t, '[^ \t\n\r\f\x0b]')::INT) OVER (PARTITION BY page_id ORDER BY k) - regexp_matches(t, '[^ \t\n\r\f\x0b]')::INT AS g FROM nd)""".replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r").replace("\\f", "\f").replace("\\x0b", "\x0b")


@query("html_text", f"WITH {_NODES} SELECT page_id, g::INT AS idx, string_agg(t, '' ORDER BY k) AS text FROM gr GROUP BY page_id, g HAVING bool_or(filled)")
def html_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.posexplode(markup.html_text(F.col("html"))).alias("idx", "text"))


def _extracted(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", markup.html_extract(F.col("html")).alias("x"))


@query("html_extract")
def html_extract(spark, sf_dir):
    return _extracted(spark, sf_dir).select("page_id", "x.text", F.size("x.tags").alias("n_tags"))


@query("html_tags", f"WITH {_NODES}, b AS (SELECT *, coalesce(sum(octet_length(encode(t))) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM nd JOIN (SELECT page_id, k, x, raw_on, r1, r0, n1, n0 FROM st) USING (page_id, k)) SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INT AS idx, lower(regexp_extract(x, '^[a-zA-Z][a-zA-Z0-9:-]*')) AS name, (n + 1)::BIGINT AS s FROM b WHERE k > 1 AND NOT raw_on AND r1 <= r0 AND n1 <= n0 AND regexp_matches(x, '^[a-zA-Z]')")
def html_tags(spark, sf_dir):
    """Opened tags and the first byte of what they hold."""
    return _extracted(spark, sf_dir).select("page_id", F.posexplode("x.tags").alias("idx", "t")).select("page_id", "idx", F.col("t.name").alias("name"), F.col("t.s").alias("s"))


@query("html_spans")
def html_spans(spark, sf_dir):
    return _extracted(spark, sf_dir).select("page_id", F.posexplode(markup.html_spans(F.col("x.tags"))).alias("idx", "p")).select("page_id", "idx", "p.s", "p.e")


@query("html_inject")
def html_inject(spark, sf_dir):
    return _extracted(spark, sf_dir).select("page_id", markup.html_inject(F.col("x.text"), F.col("x.tags"), ["class", "id"]).alias("html"))


@query("json_fields", "WITH t AS (SELECT p_partkey, list_filter([p_name, p_type], lambda x: x <> '') AS t FROM part) SELECT p_partkey, (generate_subscripts(t, 1) - 1)::INT AS idx, unnest(t) AS value FROM t")
def json_fields(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.to_json(F.struct("p_size", "p_name", F.struct("p_name").alias("nested"), F.array("p_type").alias("p_type")))
    return part.select("p_partkey", F.posexplode(markup.json_values(line, ["p_name", "p_type"])).alias("idx", "value"))


@query("json_scalar", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_scalar(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
