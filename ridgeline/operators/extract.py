"""Span extraction by ordered regular expressions over bytes: at each place the first pattern that matches and consumes, then on from its end."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ridgeline.operators import passes

_AL = "A-Za-z0-9"
_WS = r" \t\n\r\x0b\x0c"
_END = f"(?![{_AL}])"
_STOP = f"(?![^{_AL}{_WS}])"
#: Names and patterns of the shape classes, tried in this order. A word class takes a whole run of letters and digits, a punctuation class a whole run of other signs.
SHAPES: list[tuple[str, str]] = (
    [(n, p + _END) for n, p in (("caps", "[A-Z]{2,}"), ("icap", "[A-Z][a-z]+[A-Z][A-Za-z]*"), ("cap", "[A-Z][a-z]+"), ("u1", "[A-Z]"), ("low", "[a-z]+"), ("d4", "[0-9]{4}"), ("d2", "[0-9]{2}"), ("num", "[0-9]+"), ("dsuf", "[0-9]+[a-z]+"))]
    + [("alnum", f"[{_AL}]+")]
    + [(n, p + _STOP) for n, p in (("dot", r"\.+"), ("comma", ",+"), ("hyph", "-+"), ("apos", "'+"), ("quot", '["`]+'), ("paren", "[()]+"), ("amp", "&+"), ("slash", "/+"))]
    + [("punct", f"[^{_AL}{_WS}]+")]
)
SHAPE_NAMES = [n for n, _ in SHAPES]
WORD = [("word", f"[{_AL}]+")]


def extract(docs: DataFrame, patterns: list[tuple[str | None, str]], key: str = "doc_id") -> DataFrame:
    """(key, idx, s, e, ty): spans in bytes; ty is the place of the pattern's name among the named ones, their number for patterns without a name.
    Empty matches don't count. Null texts have no spans. Row by row, without a shuffle."""
    find = finder(patterns)

    def run(text: bytes, known: bool) -> list[np.ndarray]:
        found = np.array(find(text), np.int64).reshape(-1, 3)
        return [np.arange(len(found)), found[:, 0], found[:, 1], found[:, 2]]

    return passes.each(docs, run, "idx int, s long, e long, ty int", key)


def finder(patterns: list[tuple[str | None, str]]) -> Callable[[bytes], list[tuple[int, int, int]]]:
    """The function that gives (s, e, ty) of a text's spans."""
    names = [n for n, _ in patterns if n is not None]
    kinds = [len(names) if n is None else names.index(n) for n, _ in patterns]
    source = re.compile("|".join(f"({p})" for _, p in patterns).encode())
    if source.groups != len(patterns):
        raise ValueError("patterns mustn't hold groups of their own; use (?:...)")

    def find(text: bytes) -> list[tuple[int, int, int]]:
        return [(*m.span(), kinds[m.lastindex - 1]) for m in source.finditer(text) if m.end() > m.start()]

    return find


def word_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    def run(text: bytes, known: bool) -> list[np.ndarray]:
        w = passes.words(text)
        return [w.idx, w.s, w.e]

    return passes.each(docs, run, "idx int, s long, e long", key)


def shape_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return extract(docs, SHAPES, key)
