"""One pass over texts: what is found in a text, and what is worked out of it, stays in the task, and leaves it as rows in batches of bounded size or as counts.

A span set of one text is a `Spans`, arrays in the order of idx; the functions here do to it what `operators.spans`, `operators.gazetteer` and
`operators.decide` do to tables of spans, for which those are meant. doc_id names one text; where it is null, nothing can be joined to the text's spans.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch that leaves Python, about; a text's rows stay together.
ROWS = 1 << 16
#: Different counts that a task holds before it sends them on.
MOST_COUNTS = 1 << 17

_ARROW = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
_ALNUM = np.array([48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)


def bounded(batch: pa.RecordBatch, carried: list[int], results: Iterable[list[np.ndarray]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of about ROWS rows: of every row of `batch` the `carried` columns, repeated, and its result, arrays of one length."""
    sizes, parts, first, n = [], [], 0, 0

    def out() -> pa.RecordBatch:
        take = pa.array(np.repeat(np.arange(first, first + len(sizes)), sizes))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in carried), *(pa.array(np.concatenate(x).astype(k.to_pandas_dtype(), copy=False), k) for x, k in zip(zip(*parts), kinds))], names)

    for arrays in results:
        sizes.append(len(arrays[0]))
        parts.append(arrays)
        n += sizes[-1]
        if n >= ROWS:
            yield out()
            first, n = first + len(sizes), 0
            sizes, parts = [], []
    if n:
        yield out()


def texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text as bytes), null texts as null."""
    return docs.select(key, F.encode(F.col("text"), "utf-8").alias("text"))


def each(docs: DataFrame, run: Callable[[bytes, bool], list[np.ndarray]], schema: str, key: str = "doc_id") -> DataFrame:
    """(key, schema): run(text, whether it has a key) gives the columns of each text's rows. Null texts are empty."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            results = (run(t.as_py() or b"", k.is_valid) for k, t in zip(b.column(0), b.column(1)))
            yield from bounded(b, [0], results, [key, *names], [_ARROW[k] for k in kinds])

    return texts(docs, key).mapInArrow(go, f"{key} {dict(docs.dtypes)[key]}, {schema}")


def counted(docs: DataFrame, run: Callable[[bytes, bool], Counter], schema: str, key: str = "doc_id") -> DataFrame:
    """(schema, n): sums over all texts of the counts that run(text, whether it has a key) gives, by tuples of the schema's columns. Only a task's totals are shuffled."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            cols = list(zip(*held)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([*(pa.array(c, _ARROW[k]) for c, k in zip(cols, kinds)), pa.array(list(held.values()), pa.int64())], [*names, "n"])

        for b in batches:
            for k, t in zip(b.column(0), b.column(1)):
                held.update(run(t.as_py() or b"", k.is_valid))
                if len(held) > MOST_COUNTS:
                    yield out()
                    held.clear()
        yield out()

    return texts(docs, key).mapInArrow(go, f"{schema}, n long").groupBy(*names).agg(F.sum("n").alias("n"))


# --- span sets of one text ---


@dataclass
class Spans:
    s: np.ndarray
    e: np.ndarray
    idx: np.ndarray
    ty: np.ndarray

    def at(self, keep: np.ndarray) -> "Spans":
        return Spans(self.s[keep], self.e[keep], self.idx[keep], self.ty[keep])

    @property
    def both(self) -> np.ndarray:
        return self.s << 32 | self.e


def of(s: np.ndarray, e: np.ndarray, ty: np.ndarray | int = 0) -> Spans:
    return Spans(s, e, np.arange(s.size), np.broadcast_to(ty, s.shape))


def words(text: bytes) -> Spans:
    """Runs of ASCII letters and digits."""
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = _ALNUM[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return of(edges[::2], edges[1::2])


def listed(text: bytes, x: Spans, table: dict[bytes, int]) -> Spans:
    """The spans whose bytes, in ASCII lower case, are in the table, with its types."""
    raw, ty = _LOWER[np.frombuffer(text, np.uint8)], np.full(x.s.size, -1)
    for n in {len(w) for w in table}:
        some = np.flatnonzero(x.e - x.s == n)
        if some.size and n:
            rows = np.ascontiguousarray(raw[x.s[some, None] + np.arange(n)]).view(f"S{n}").ravel().tolist()
            ty[some] = [table.get(w, -1) for w in rows]
    keep = ty >= 0
    return Spans(x.s[keep], x.e[keep], x.idx[keep], ty[keep])


def followed(x: Spans, ty: int) -> Spans:
    """Every span to the end of the next one."""
    return Spans(x.s[:-1], x.e[1:], x.idx[:-1], np.full(max(x.s.size - 1, 0), ty))


def first_types(x: Spans, gold: Spans, missing: int) -> np.ndarray:
    """The type of the first of gold with the same bounds, for each of x."""
    keys, first = np.unique(gold.both, return_index=True)
    at = np.minimum(np.searchsorted(keys, x.both), max(keys.size - 1, 0))
    return np.where(keys[at] == x.both, gold.ty[first][at], missing) if keys.size else np.full(x.s.size, missing)


def aligned(x: Spans, tokens: Spans) -> np.ndarray:
    """Which of x begin where a token begins and end where one ends."""
    return np.isin(x.s, tokens.s) & np.isin(x.e, tokens.e)


def within(x: Spans, outer: Spans) -> np.ndarray:
    """Which of x lie within one of the others."""
    order = np.argsort(outer.s, kind="stable")
    reach = np.maximum.accumulate(np.append(-1, outer.e[order]))
    return reach[np.searchsorted(outer.s[order], x.s, "right")] >= x.e


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return edges[::2], edges[1::2]


def longest(s: np.ndarray, e: np.ndarray, id_: np.ndarray) -> np.ndarray:
    """Greedy choice by start, then length, then id: spans that begin before the last kept one's end go."""
    order = np.lexsort((id_, -e, s))
    after = np.maximum(np.searchsorted(s[order], e[order]), np.arange(1, s.size + 1)).tolist()
    kept, i = [], int(np.searchsorted(s[order], -1))
    while i < len(after):
        kept.append(i)
        i = after[i]
    return order[kept] if kept else np.zeros(0, np.int64)


OUTCOMES = ("covered", "wrong_type", "over", "under", "cross", "none")


def misses(gold: Spans, gaz: Spans, bio: Spans) -> Counter:
    """(ty, outcome, by_gaz, by_bio) of the gold spans, counted; see `operators.spans.miss_report`."""
    x, y, ty = (np.concatenate([getattr(gaz, c), getattr(bio, c)]) for c in ("s", "e", "ty"))
    g = gold
    types = {}
    for a, t in zip((x << 32 | y).tolist(), ty.tolist()):
        types.setdefault(a, set()).add(t)
    same = [types.get(k) for k in g.both.tolist()]
    over, some = _around(g, x, y)
    by_gaz, by_bio = _inside(g, gaz), _inside(g, bio)
    out = []
    for t, own, o, a, b, c in zip(g.ty.tolist(), same, over.tolist(), by_gaz.tolist(), by_bio.tolist(), some.tolist()):
        k = 0 if own and t in own else 1 if own else 2 if o else 3 if a or b else 4 if c else 5
        out.append((t, OUTCOMES[k], k == 3 and a, k == 3 and b))
    return Counter(out)


def _around(g: Spans, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of g lie within one of (x, y) that isn't the same, and which overlap one that begins before their end."""
    order = np.argsort(x, kind="stable")
    xs, reach = x[order], np.maximum.accumulate(np.append(-1, y[order]))
    over = reach[np.searchsorted(xs, g.s)] >= g.e
    over |= reach[np.searchsorted(xs, g.s, "right")] > g.e
    return over, reach[np.searchsorted(xs, g.e)] > g.s


def _inside(g: Spans, o: Spans) -> np.ndarray:
    """Which of g have one of the others within them that isn't the same."""
    order = np.argsort(o.s, kind="stable")
    s, least = o.s[order], np.append(np.minimum.accumulate(o.e[order][::-1])[::-1], np.iinfo(np.int64).max)
    after = least[np.searchsorted(s, g.s, "right")] <= g.e
    own = np.lexsort((o.e, o.s))  # of those with the same start, the least end comes first
    at = np.searchsorted(o.s[own], g.s)
    there = at < own.size
    at = np.minimum(at, max(own.size - 1, 0))
    return after | (there & (o.s[own][at] == g.s) & (o.e[own][at] < g.e)) if own.size else after
