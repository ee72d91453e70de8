"""Pieces of DuckDB SQL that several queries' checks share."""

#: (doc_id, k, t, s, e) of runs of letters and digits (w: those only, with idx), in bytes.
RUNS = r"""p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS ps FROM documents),
q AS (SELECT doc_id, generate_subscripts(ps, 1) AS k, unnest(ps) AS t FROM p),
r AS (SELECT doc_id, k, t, octet_length(encode(t)) AS n, sum(octet_length(encode(t))) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM q),
w AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS idx, (e - n)::BIGINT AS s, e::BIGINT AS e, t FROM r WHERE regexp_matches(t, '^[A-Za-z0-9]'))"""

#: Words that stand for gold spans in the queries over documents, with their types.
GOLD_WORDS = {"the": 0, "and": 0, "her": 0, "der": 1, "und": 1, "die": 1, "los": 2, "de": 2, "en": 2, "les": 3, "et": 3}
N_TYPES = 4

_VALUES = ", ".join(f"('{w}', {t})" for w, t in GOLD_WORDS.items())
GOLD = f"""{RUNS},
gw AS (SELECT * FROM (VALUES {_VALUES}) v(word, ty)),
gold AS (SELECT doc_id, idx, s, e, ty, t FROM w JOIN gw ON lower(t) = word)"""



def grams(table: str, hex_: str, n: int, more: str = "") -> str:
    """Byte n-grams of a column of hex strings, as hex."""
    item = " || ".join(f"b[i + {k}]" for k in range(n))
    return f"SELECT doc_id{more}, unnest(list_transform(range(1, greatest(len(b) - {n - 2}, 1)), lambda i: {item})) AS x FROM (SELECT doc_id{more}, regexp_extract_all({hex_}, '..') AS b FROM {table})"


def number(x: str) -> str:
    return f"('0x' || {x})::BIGINT"
