"""Gazetteers: how often a surface, or each of its character n-grams, is a gold span of each type, as features of candidate spans."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.operators import passes
from ridgeline.operators.passes import Spans

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for raw, starts, ends in batches:
        yield pd.Series([None if t is None else [t[a:b].hex().upper() for a, b in zip(s, e)] for t, s, e in zip(raw, starts, ends)], dtype=object)


def surface(spans: DataFrame, docs: DataFrame, lower: bool = True) -> DataFrame:
    """spans with surface: hex of the bytes of the text under each, in ASCII lower case. A document meets all of its spans at once, so a text is
    neither copied nor encoded for each of them."""
    g = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*spans.columns)).alias("_a"))
    text = F.translate(F.col("text"), _UPPER, _LOWER) if lower else F.col("text")
    x = docs.select("doc_id", F.encode(text, "utf-8").alias("_raw")).join(g, "doc_id")
    cut = _cut("_raw", F.transform("_a", lambda p: p["s"].cast("long")), F.transform("_a", lambda p: p["e"].cast("long")))
    return x.select("_a", cut.alias("_s")).select(F.explode(F.arrays_zip("_a", "_s")).alias("_p")).select("_p._a.*", F.col("_p._s").alias("surface"))


def _grams(c: Column, lo: int, hi: int) -> Column:
    """All byte n-grams of a hex string, with multiplicity."""
    size = (F.length(c) / 2).cast("int")

    def of(n: int) -> Column:
        return F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.substring(c, i * 2 + 1, F.lit(2 * n)))).otherwise(F.array().cast("array<string>"))

    parts = [of(n) for n in range(lo, hi + 1)]
    return F.flatten(F.array(*parts))


#: Up to so many counts are sent to the tasks to look surfaces up in; more are joined by a shuffle.
MOST_SENT = 200_000


def _byte_grams(raw: bytes, ngrams: tuple[int, int] | None) -> list[bytes]:
    return [raw] if ngrams is None else [raw[i : i + n] for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(raw) - n + 1)]


@dataclass
class Gazetteer:
    """counts: (surface, ty, n), ty -1 for all types together, those out of range included."""

    counts: DataFrame
    n_types: int
    ngrams: tuple[int, int] | None = None

    @staticmethod
    def build(docs: DataFrame, gold: DataFrame, n_types: int, ngrams: tuple[int, int] | None = None) -> "Gazetteer":
        s = surface(gold, docs)
        s = s.select(F.explode(_grams(F.col("surface"), *ngrams)).alias("surface"), "ty") if ngrams else s.select("surface", "ty")
        ty = F.when(F.col("ty").between(0, n_types - 1), F.col("ty").cast("int"))
        each = s.select("surface", F.explode(F.array(F.lit(-1), ty)).alias("ty")).where("ty IS NOT NULL")
        return Gazetteer(each.groupBy("surface", "ty").agg(F.count("*").alias("n")), n_types, ngrams)

    @staticmethod
    def found(docs: DataFrame, find: Callable[[bytes], Spans], n_types: int, ngrams: tuple[int, int] | None = None) -> "Gazetteer":
        """`build` of gold spans that find(text) gives: counted within one pass over the texts."""

        def run(text: bytes, known: bool) -> Counter:
            out, low, g = Counter(), text.lower(), find(text)
            for a, b, ty in zip(g.s.tolist(), g.e.tolist(), g.ty.tolist()):
                for x in _byte_grams(low[a:b], ngrams):
                    x = x.hex().upper()
                    out[x, -1] += 1
                    if 0 <= ty < n_types:
                        out[x, ty] += 1
            return out

        return Gazetteer(passes.counted(docs, run, "surface string, ty int"), n_types, ngrams)

    def block_found(self, docs: DataFrame, find: Callable[[bytes, bool], Spans]) -> DataFrame:
        """`block` of the candidates that find(text, whether it has a doc_id) gives, typed by their own gold type: within one pass over the texts where the counts are short."""
        counts = self.counts.limit(MOST_SENT + 1).collect()
        if len(counts) > MOST_SENT:
            cand = passes.each(docs, lambda text, known: [(x := find(text, known)).s, x.e, x.ty], "s long, e long, ty int")
            return self.block(docs, cand, "ty")
        table: dict[bytes, tuple[int, list[tuple[int, int]]]] = {}
        for r in sorted(counts):
            x = bytes.fromhex(r["surface"])
            if r["ty"] < 0:
                table[x] = (r["n"], [])
            else:
                table[x][1].append((r["ty"], r["n"]))
        shared, ngrams, n_types = docs.sparkSession.sparkContext.broadcast(table), self.ngrams, self.n_types

        def run(text: bytes, known: bool) -> list[np.ndarray]:
            look, low, c = shared.value, text.lower(), find(text, known)
            sums: dict[tuple[int, int, int], float] = {}
            for a, b, own in zip(c.s.tolist(), c.e.tolist(), c.ty.tolist()):
                for x in _byte_grams(low[a:b], ngrams):
                    total, typed = look.get(x, (0, ()))
                    total -= 0 <= own < n_types
                    for ty, n in typed:
                        n -= ty == own
                        if n > 0 and total > 0:
                            sums[a, b, ty] = sums.get((a, b, ty), 0.0) + n / total
            keys = np.array(list(sums), np.int64).reshape(-1, 3)
            return [keys[:, 0], keys[:, 1], keys[:, 2], np.array(list(sums.values()), float)]

        return passes.each(docs, run, "s long, e long, col int, val double")

    def block(self, docs: DataFrame, cand: DataFrame, own: str | None = None) -> DataFrame:
        """(doc_id, s, e, col, val): share of each type among a candidate's surface; summed over n-grams. own: column of the
        candidate's own gold type, which is then left out of the counts (n_types or more: it is none, and nothing is left out)."""
        c = surface(cand.withColumn("_own", F.col(own).cast("int") if own else F.lit(self.n_types)), docs)
        c = c.select("doc_id", "s", "e", "_own", F.explode(_grams(F.col("surface"), *self.ngrams)).alias("surface")) if self.ngrams else c.select("doc_id", "s", "e", "_own", "surface")
        mine = F.col("_own").between(0, self.n_types - 1)
        total = self.counts.where("ty = -1").select("surface", F.col("n").alias("total"))
        typed = self.counts.where("ty >= 0").join(total, "surface")
        x = c.join(typed, "surface")
        den = F.col("total") - F.when(mine, 1).otherwise(0)
        num = F.col("n") - F.when(mine & (F.col("ty") == F.col("_own")), 1).otherwise(0)
        x = x.withColumns({"_num": num, "_den": den}).where("_num > 0 AND _den > 0")
        return x.groupBy("doc_id", "s", "e", F.col("ty").alias("col")).agg(F.sum(F.col("_num") / F.col("_den")).alias("val"))


def surface_types(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(surface, ty): the most frequent type of each surface, case kept; the least of equals. Surfaces as hex of their bytes, to be patterns."""
    return _most_frequent(surface(gold, docs, lower=False).groupBy("surface", "ty").agg(F.count("*").alias("n")))


def types_found(docs: DataFrame, find: Callable[[bytes], Spans]) -> DataFrame:
    """`surface_types` of gold spans that find(text) gives: counted within one pass over the texts."""

    def run(text: bytes, known: bool) -> Counter:
        g = find(text)
        return Counter((text[a:b].hex().upper(), ty) for a, b, ty in zip(g.s.tolist(), g.e.tolist(), g.ty.tolist()))

    return _most_frequent(passes.counted(docs, run, "surface string, ty int"))


def _most_frequent(n: DataFrame) -> DataFrame:
    return n.groupBy("surface").agg(F.max_by("ty", F.struct("n", -F.col("ty"))).alias("ty"))
