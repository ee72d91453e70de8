"""Dictionary matching: all places of all patterns in one pass over each text, with filters in a fixed order (tokens, excluded regions, longest)."""

from __future__ import annotations

import html
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.normalize import fold, fold_with_offsets
from ridgeline.operators import passes

Match = tuple[int, int, int]  # s, e, id
#: Texts whose matches are held at a time.
TEXTS = 256


@dataclass(frozen=True)
class Matcher:
    """patterns are numbered from 0. Of equal patterns the one with the least priority counts, then the first. Empty ones match nothing.
    normalize: patterns and texts are folded to ASCII lower case; offsets are those of the original bytes."""

    patterns: tuple[bytes, ...]
    priorities: tuple[int, ...] | None = None
    names: tuple[str, ...] | None = None
    normalize: bool = False

    @staticmethod
    def of(patterns: list[str], **more) -> "Matcher":
        return Matcher(tuple(p.encode() for p in patterns), **{k: tuple(v) if isinstance(v, list) else v for k, v in more.items()})

    def __post_init__(self):
        if self.priorities is not None and len(self.priorities) != len(self.patterns):
            raise ValueError("a priority for each pattern")

    def _priority(self, i: int) -> tuple[int, int]:
        return (self.priorities[i] if self.priorities else 0, i)

    def automaton(self):
        """Bytes stand as the characters of the same number. None without patterns."""
        import ahocorasick

        a = ahocorasick.Automaton()
        chosen: dict[str, int] = {}
        for i, p in enumerate(self.patterns):
            k = (fold(p.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape") if self.normalize else p).decode("latin-1")
            if k and (k not in chosen or self._priority(i) < self._priority(chosen[k])):
                chosen[k] = i
        for k, i in chosen.items():
            a.add_word(k, (i, len(k)))
        if not chosen:
            return None
        a.make_automaton()
        return a

    def n_states(self) -> int:
        a = self.automaton()
        return a.get_stats()["nodes_count"] if a else 1

    def matches(self, a, text: bytes) -> list[Match]:
        """All matches by their end, the longest of one end first."""
        if a is None or not text:
            return []
        if not self.normalize:
            return [(e + 1 - n, e + 1, i) for e, (i, n) in a.iter(text.decode("latin-1"))]
        raw, start, end = fold_with_offsets(text.decode("utf-8", "surrogateescape"))
        nxt = [*start[1:].tolist(), len(text)]  # what folds to nothing goes with what stands before it
        return [(int(start[e + 1 - n]), max(int(end[e]), nxt[e]), i) for e, (i, n) in a.iter(raw.decode("latin-1"))]

    def filtered(self, found: list[Match], tokens: list[tuple[int, int]] | None, exclude: list[tuple[int, int]], longest: bool) -> tuple[list[Match], set[int]]:
        """The matches that are left, and the numbers of the regions that took some out."""
        hit: set[int] = set()
        if tokens is not None:
            starts, ends = {t[0] for t in tokens}, {t[1] for t in tokens}
            found = [m for m in found if m[0] in starts and m[1] in ends]
        if exclude:
            kept = []
            for m in found:
                k = next((k for k, (lo, hi) in enumerate(exclude) if m[0] < hi and m[1] > lo), None)
                kept.append(m) if k is None else hit.add(k)
            found = kept
        if longest:
            last, kept = -1, []
            for m in sorted(found, key=lambda m: (m[0], -m[1], self._priority(m[2]))):
                if m[0] >= last:
                    kept.append(m)
                    last = m[1]
            found = kept
        return found, hit

    def _run(self, docs: DataFrame, tokens: DataFrame | str | None, exclude, longest: bool, key: str, emit, schema: str) -> DataFrame:
        x = docs.select(key, F.encode(F.col("text"), "utf-8").alias("text"))
        found = isinstance(tokens, str)
        if found and tokens != "words":
            raise ValueError(f"no tokens {tokens}")
        if tokens is not None and not found:
            t = tokens.groupBy(key).agg(F.collect_set(F.struct(F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))).alias("tokens"))
            x = x.join(t, key, "left").select(key, "text", F.coalesce("tokens", F.array().cast("array<struct<s:long,e:long>>")).alias("tokens"))
        own = x.sparkSession.sparkContext.broadcast(self)  # patterns; each worker builds its automaton
        regions, by_tokens = list(exclude or []), tokens is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = own.value.automaton()
            for whole in batches:
                for at in range(0, whole.num_rows, TEXTS):
                    b = whole.slice(at, TEXTS)
                    texts = b.column(1).to_pylist()
                    if found:
                        toks = [words(t) if k.is_valid else [] for k, t in zip(b.column(0), texts)]
                    else:
                        toks = [[(p["s"], p["e"]) for p in k] for k in b.column(2).to_pylist()] if by_tokens else [None] * len(texts)
                    results = [own.value.filtered(own.value.matches(a, t or b""), k, regions, longest) for t, k in zip(texts, toks)]
                    yield emit(b.column(0), texts, results)

        def words(text: bytes | None) -> list[tuple[int, int]]:
            w = passes.words(text or b"")
            return list(zip(w.s.tolist(), w.e.tolist()))

        return x.mapInArrow(run, schema)

    def predict(self, docs: DataFrame, longest: bool = False, exclude: list[tuple[int, int]] | None = None, tokens: DataFrame | str | None = None, key: str = "doc_id") -> DataFrame:
        """(key, idx, id, s, e). exclude: regions (lo, hi) of every text; tokens: (key, s, e), whose bounds matches must have, or "words"
        for the runs of letters and digits, which are found in the same pass."""
        kind = dict(docs.dtypes)[key]

        def emit(ids, texts, results):
            rows = [(i, k, m[2], m[0], m[1]) for i, (found, _) in enumerate(results) for k, m in enumerate(found)]
            cols = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *(pa.array(cols[j], t) for j, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64())))], [key, "idx", "id", "s", "e"])

        return self._run(docs, tokens, exclude, longest, key, emit, f"{key} {kind}, idx int, id long, s long, e long")

    def exclude_hits(self, docs: DataFrame, exclude: list[tuple[int, int]], tokens: DataFrame | str | None = None, key: str = "doc_id") -> DataFrame:
        """(region, hit): 1 for each region that took a match out in some text. A match counts for the first region it overlaps."""

        def emit(ids, texts, results):
            k = [k for _, hit in results for k in sorted(hit)]
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32())], ["region"])

        hit = self._run(docs, tokens, exclude, False, key, emit, "region int").distinct().withColumn("_h", F.lit(1))
        every = docs.sparkSession.createDataFrame([(k,) for k in range(len(exclude))], "region int")
        return every.join(hit, "region", "left").select("region", F.coalesce("_h", F.lit(0)).alias("hit"))

    def tag(self, docs: DataFrame, fmt: str, longest: bool = True, exclude: list[tuple[int, int]] | None = None, tokens: DataFrame | str | None = None, key: str = "doc_id") -> DataFrame:
        """(key, text): each match replaced by the format: %match, %name, %id, and with an h before them the same escaped for HTML; %% is a
        percent sign unless it ends the format. Null texts stay null."""
        kind = dict(docs.dtypes)[key]
        parts = _parse(fmt)

        def emit(ids, texts, results):
            out = []
            for t, (found, _) in zip(texts, results):
                if t is None:
                    out.append(None)
                    continue
                row, at = [], 0
                for s, e, i in found:
                    row.append(t[at:s] if s > at else b"")
                    row.append(_fill(parts, t[s:e], self.names[i] if self.names and i < len(self.names) else "", i))
                    at = e
                out.append(b"".join([*row, t[at:]]).decode("utf-8", "replace"))
            return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], [key, "text"])

        return self._run(docs, tokens, exclude, longest, key, emit, f"{key} {kind}, text string")


def _parse(fmt: str) -> list[str]:
    out, at = [], 0
    while at < len(fmt):
        name = next((n for n in ("%hmatch", "%hname", "%hid", "%match", "%name", "%id") if fmt.startswith(n, at)), None)
        if fmt.startswith("%%", at) and at + 2 < len(fmt):
            out.append("%")
            at += 2
        elif name:
            out.append(name)
            at += len(name)
        else:
            out.append(fmt[at])
            at += 1
    return out


def _fill(parts: list[str], match: bytes, name: str, i: int) -> bytes:
    values = {"match": match, "name": name.encode(), "id": str(i).encode()}
    safe = {f"h{k}": html.escape(v.decode("latin-1")).replace("&#x27;", "&#39;").encode("latin-1") for k, v in values.items()}
    return b"".join((values | safe)[p[1:]] if len(p) > 1 else p.encode() for p in parts)
