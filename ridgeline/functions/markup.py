"""HTML and JSON helpers: text nodes by built-in functions; tags with positions, their matching and re-injection, and JSON fields, in Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What isn't text: comments, scripts, styles and tags. The same in Java's and RE2's syntax.
NOT_TEXT = r"(?i)<!--(?s:.)*?-->|<script\b(?s:.)*?</script\s*>|<style\b(?s:.)*?</style\s*>|<[^>]*>"


def html_text(html: Column) -> Column:
    """array<string> of the text nodes, in order. Blanks alone between two tags aren't a node, but go before the next one's text; at the end
    they are left out. Entities stay as they are."""
    cut = F.regexp_replace(html, NOT_TEXT, "\x00")
    joined = F.regexp_replace(cut, "(?<=^|\x00)([ \\t\\n\\r\\f\\x0B]*)\x00", "$1")  # a cut after nothing but blanks goes
    return F.filter(F.split(joined, "\x00"), lambda t: F.regexp_like(t, F.lit(r"[^ \t\n\r\f\x0B]")))


_SKIP = re.compile(r"<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[^>]*>", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
TAG = T.StructType([T.StructField("name", T.StringType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType())])
EXTRACT = T.StructType([T.StructField("text", T.StringType()), T.StructField("tags", T.ArrayType(TAG))])


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTR.finditer(raw)}


def extract(html: str) -> tuple[str, list[dict]]:
    """The text without tags, and the tags that are opened, in order: name, 1-based first and last byte of what they hold, attributes.
    Tags left open end where their parent ends; void ones hold nothing."""
    html = _SKIP.sub("", html)
    out, tags, open_, at, size = [], [], [], 0, 0

    def put(t: str) -> None:
        nonlocal size
        out.append(t)
        size += len(t.encode("utf-8", "surrogatepass"))

    for m in _TAG.finditer(html):
        put(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(open_) - 1, -1, -1):
                if tags[open_[k]]["name"] == name:
                    for t in open_[k:]:
                        tags[t]["e"] = size
                    del open_[k:]
                    break
            continue
        tags.append({"name": name, "s": size + 1, "e": size, "attrs": attributes(m[3].rstrip("/")), "text": None})
        if name not in _VOID and not m[3].endswith("/"):
            open_.append(len(tags) - 1)
    put(html[at:])
    for t in open_:
        tags[t]["e"] = size
    return "".join(out), tags


def inject(text: str, tags: list[dict], order: list[str] | None = None) -> str:
    """The text with the tags put in around their bytes; attributes in the given order, then the others by name. A tag's `text` stands for what it holds."""
    raw, marks = text.encode(), []
    gone: list[tuple[int, int]] = []
    for i, t in enumerate(tags):
        s, e = t["s"] - 1, t["e"]
        names = [k for k in order or [] if k in t["attrs"]] + sorted(k for k in t["attrs"] if k not in (order or []))
        first = f"<{t['name']}" + "".join(f' {k}="{t["attrs"][k]}"' for k in names) + ">"
        marks += [(s, 1, -e, i, first.encode() + (t["text"] or "").encode()), (e, 0 if e > s else 2, -s, -i, f"</{t['name']}>".encode())]
        if t["text"] is not None:
            gone.append((s, e))
    out, at = [], 0

    def copy(a: int, b: int) -> None:
        for lo, hi in sorted(gone):
            if a < hi and lo < b:
                out.append(raw[a : max(a, lo)])
                a = max(a, hi)
        out.append(raw[a:b] if a < b else b"")

    for where, *_, mark in sorted(marks):
        copy(at, where)
        at = max(at, where)
        out.append(mark)
    copy(at, len(raw))
    return b"".join(out).decode("utf-8", "replace")


def match_tags(matches: list[tuple[int, int, int]], names: dict[int, str] | None = None, prefix: str = "") -> list[dict]:
    """Tag records of matches (id, s, e), half open: spans whose class is the prefix and the match's name, or its id without a name."""
    return [{"name": "span", "s": s + 1, "e": e, "attrs": {"class": prefix + str((names or {}).get(i, i))}, "text": None} for i, s, e in matches]


def tags_of_matches(matches: DataFrame, names: dict[int, str] | None = None, prefix: str = "") -> DataFrame:
    """(doc_id, name, s, e, class) of matches (doc_id, id, s, e), as match_tags() makes them."""
    named = F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("id").cast("int")] if names else F.lit(None).cast("string")
    return matches.select("doc_id", F.lit("span").alias("name"), (F.col("s") + 1).alias("s"), "e", F.concat(F.lit(prefix), F.coalesce(named, F.col("id").cast("string"))).alias("class"))


@F.pandas_udf(EXTRACT)
def _extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        rows = [(None, None) if t is None else extract(t) for t in s]
        yield pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object), "tags": pd.Series([r[1] for r in rows], dtype=object)})


def html_extract(html: Column) -> Column:
    """struct<text, tags> of a page."""
    return _extract(html)


def html_tags(html: Column) -> Column:
    """array of the tags opened in a page, with their attributes."""
    return _extract(html)["tags"]


def html_spans(tags: Column) -> Column:
    """array<struct<s, e>>: 0-based half-open bytes of tags."""
    return F.transform(tags, lambda t: F.struct((t["s"] - 1).alias("s"), t["e"].alias("e")))


def html_inject(text: Column, tags: Column, order: list[str] | None = None) -> Column:
    def put(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else inject(x, [dict(t) | {"attrs": dict(t["attrs"] or {})} for t in (y if y is not None else [])], order) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(put, T.StringType())(text, tags)


# --- JSON ------------------------------------------------------------------------------------------------------------

_STRING = r'"((?:[^"\\]|\\.)*)"'
_ITEM = re.compile(rf"\s*(?:{_STRING}|([\[\]{{}},:])|([^\s\[\]{{}},:\"]+))", re.S)


def json_fields(line: str, fields: list[str]) -> list[str]:
    """Values of an object's own fields with these names, in the order of the text: strings, and the strings of arrays. Nested objects' fields,
    other values and empty strings don't count. Escapes stay as they are written."""
    out, stack, key, want = [], [], None, False
    for m in _ITEM.finditer(line):
        if m[2]:
            c = m[2]
            if c in "{[":
                stack.append(c)
                want = c == "{"
            elif c in "}]":
                if stack:
                    stack.pop()
                want = False
            elif c == ",":
                want = bool(stack) and stack[-1] == "{"
            elif c == ":":
                want = False
        elif m[1] is not None:
            if want:
                if len(stack) == 1:
                    key = m[1]
                want = False
            elif m[1] and key in fields and (stack == ["{"] or stack == ["{", "["]):
                out.append(m[1])
    return out


def json_values(line: Column, fields: list[str]) -> Column:
    """array<string> of json_fields()."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else json_fields(t, fields) for t in s], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(line)
