"""Near duplicates by ProbMinHash.

A document is a weighted set: its runs of `k` words, each weighing as often as it occurs. Every element gives arrivals of a Poisson process
whose rate is its weight; each arrival falls on one of m components, and a component keeps the element that arrives first. Two documents
agree in a component with the probability Jaccard similarity of their sets. An element stops when its next arrival comes after the latest
of the first arrivals so far. Documents that agree in all components of a band are candidates, whose similarity is then computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import BROADCAST_IDS, Work, bound_batches, by_ids, hidden, mix, named, pieces, shared_dir, shingles, small_batches, text_buffer, units, words
from ridgeline.llm.components import components

_DOC_BITS = 20
_SHINGLE = np.uint64((1 << (64 - _DOC_BITS)) - 1)
_STEP = np.uint64(0x9FB21C651E98DF25)


def weighted_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (44 bits, in order within each text), their counts, and the text of each; fewer than 2^20 texts."""
    h, _, _, at = words(data, offsets)
    s, so = shingles(h, at, k)
    doc = np.repeat(np.arange(offsets.size - 1, dtype=np.uint64), np.diff(so))
    key = np.sort((doc << np.uint64(64 - _DOC_BITS)) | (s >> np.uint64(_DOC_BITS)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.zeros(0, int)
    count = np.diff(np.append(first, key.size))
    key = key[first]
    return key & _SHINGLE, count, (key >> np.uint64(64 - _DOC_BITS)).astype(np.int64)


def signatures(s: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m first elements by component (32 bits each, beside their arrival); rows of empty texts are all ones."""
    q = np.full(n * m, np.uint64(0xFFFFFFFFFFFFFFFF))
    low = mix(s, 3) & np.uint64(0xFFFFFFFF)
    arrived, t = np.zeros(s.size), 0
    rate = 1.0 / weight
    while s.size:
        steps = max(1, min(64, 20_000 // s.size))
        r = mix(s[:, None] + (np.arange(t, t + steps, dtype=np.uint64) * _STEP)[None, :], 5)
        gap = -np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) * rate[:, None]
        h = np.cumsum(gap, axis=1) + arrived[:, None]
        component = ((r & np.uint64(0xFFFFF)) * np.uint64(m)) >> np.uint64(20)
        at = doc[:, None] * m + component.astype(np.int64)
        bits = h.astype(np.float32).view(np.uint32).astype(np.uint64)
        np.minimum.at(q, at.ravel(), ((bits << np.uint64(32)) | low[:, None]).ravel())
        t += steps
        arrived = h[:, -1]
        open_docs = np.unique(doc)
        latest = np.zeros(n, np.uint64)
        latest[open_docs] = q.reshape(n, m)[open_docs].max(axis=1) >> np.uint64(32)
        going = bits[:, -1] < latest[doc]
        s, low, rate, arrived, doc = s[going], low[going], rate[going], arrived[going], doc[going]
    return q.reshape(n, m) & np.uint64(0xFFFFFFFF)


def probability_jaccard(sa: np.ndarray, ca: np.ndarray, sb: np.ndarray, cb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets given by their sorted elements; 0 if either is empty."""
    both, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    if not both.size:
        return 0.0
    x, y = ca[ia].astype(float), cb[ib].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    from_x = ca.sum() - x.sum() + np.cumsum(x[::-1])[::-1]
    from_y = cb.sum() - y.sum() + np.cumsum(y) - y
    return float((1 / (from_x / x + from_y / y)).sum())


def _bands(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    m = bands * rows
    for batch in batches:
        for b in pieces(batch):
            n = b.num_rows
            s, c, doc = weighted_sets(*text_buffer(b.column(1)), k)
            sig = signatures(s, c.astype(float), doc, n, m).reshape(n, bands, rows)
            h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands))
            for j in range(rows):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, j])
            start = np.searchsorted(doc, np.arange(n))
            some = np.diff(np.append(start, doc.size)) > 0
            f = []
            for seed in (11, 12):
                x = np.zeros(doc.size + 1, np.uint64)
                np.cumsum(mix(s * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64), seed), out=x[1:])
                f.append((x[np.append(start[1:], doc.size)] - x[start])[some].view(np.int64))
            h = np.ascontiguousarray(h[some]).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, bands, dtype=np.int32)), pa.array(h))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), pa.array(f[0]), pa.array(f[1]), lists], ["doc_id", "f1", "f2", "bands"])


def _verify(batches: Iterator[pa.RecordBatch], k: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch, "text_a"):
            sides = []
            for name in ("text_a", "text_b"):
                s, c, doc = weighted_sets(*text_buffer(b.column(b.schema.get_field_index(name))), k)
                sides.append((s, c, np.searchsorted(doc, np.arange(b.num_rows + 1))))
            (sa, ca, oa), (sb, cb, ob) = sides
            sim = np.array([probability_jaccard(sa[oa[i] : oa[i + 1]], ca[oa[i] : oa[i + 1]], sb[ob[i] : ob[i + 1]], cb[ob[i] : ob[i + 1]]) for i in range(b.num_rows)])
            ok = sim >= least
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok)), pa.array(sim[ok])], ["a", "b", "similarity"])


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b) of pairs (a, b), a written table. Only texts that some pair needs are shuffled."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    some = by_ids(texts, ids, "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    t = pairs.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return t.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")


#: A bucket's members are compared in tasks of so many with all the others.
SALT_ROWS = 2000


def near_duplicates(docs: DataFrame, k: int = 3, bands: int = 40, rows: int = 4, least: float = 0.5, driver_edges: int | None = None, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(doc_id, kept_id, group_size, text_hash) for every document that is a copy: its group's kept document is the one with the least doc_id.

    A group is a connected component of the pairs with a probability Jaccard of `least` or more among all that share a band; with 40 bands
    of 4, a pair at 0.5 does so with probability 0.92, at 0.6 with 0.996. Documents with the same weighted set are joined without
    comparing them. Of the others, each band's documents are compared with its least one, and then with each other unless they are in
    one component by then, so that a band's pairs are all settled and copies in their thousands cost thousands of comparisons.

    Null or empty texts, and those without words, are in no group; texts of fewer than k words are one shingle. Rows with a null doc_id can't be named and
    are left out; rows that repeat doc_id and text are one document, never a copy of itself. Different texts under one doc_id are different documents,
    all but the least in order of which are later than all others; which of them is a copy is told by text_hash, the xxhash64 of its text, which is null for all other documents.
    An empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    bound_batches(spark)
    work = Work(spark)
    cc = {} if driver_edges is None else {"driver_edges": driver_edges}
    raw, names = units(docs, work)
    texts = raw.select("doc_id", F.lower("text").alias("text"))
    sig = work.table(texts.mapInArrow(lambda it: _bands(it, k, bands, rows), "doc_id long, f1 long, f2 long, bands array<long>"))
    reps = sig.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    same = Window.partitionBy("f1", "f2")
    exact = sig.select("doc_id", F.min("doc_id").over(same).alias("rep")).where("doc_id > rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    bucket = Window.partitionBy("bucket")
    shared = work.table(reps.select("rep", F.explode("bands").alias("bucket")).withColumns({"leader": F.min("rep").over(bucket), "last": F.max("rep").over(bucket)}).where("leader < last").drop("last"))

    def verified(pairs: DataFrame) -> DataFrame:
        p = work.table(pairs.distinct())
        with small_batches(spark):
            return work.table(with_texts(p, texts).mapInArrow(lambda it: _verify(it, k, least), "a long, b long, similarity double"))

    first = verified(shared.where("rep > leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")))
    label = components(first, work, **cc)
    m = shared.join(label, shared.rep == label.id, "left").select("bucket", "rep", "leader", F.coalesce("component", "rep").alias("c"))
    m = m.withColumns({"c0": F.min("c").over(bucket), "c1": F.max("c").over(bucket), "salts": F.ceil(F.count("*").over(bucket) / salt_rows).cast("int")}).where("c0 < c1 AND rep > leader").select("bucket", "rep", "c", "salts")
    m = work.table(m)
    x = m.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    y = m.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    pairs = x.alias("x").join(y.alias("y"), F.expr("x.bucket = y.bucket AND x.salt = y.salt AND x.rep < y.rep AND x.c <> y.c")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    second = verified(pairs)
    label = components(first.select("a", "b").unionAll(second.select("a", "b")).unionAll(exact), work, **cc)
    size = label.groupBy("component").agg(F.count("*").alias("group_size"))
    out = label.join(size, "component").where("id > component").select(F.col("id").alias("doc_id"), F.col("component").alias("kept_id"), "group_size")
    if names is None:
        out = out.withColumn("text_hash", F.lit(None).cast("long"))
    else:
        hashes = by_ids(raw, names.select("unit"), "left_semi").select(F.col("doc_id").alias("_of"), F.xxhash64("text").alias("text_hash")).distinct()
        out = named(out.join(hashes, F.col("doc_id") == F.col("_of"), "left").drop("_of"), names, "doc_id", "kept_id")
    out = out.select("doc_id", "kept_id", "group_size", "text_hash").checkpoint()
    work.drop()
    return out


def without_copies(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of `docs` that aren't among `copies`, with one row of those that repeat doc_id and text (that whose columns come first as JSON).

    Rows with a null doc_id stay, each of them, and so do null and empty texts. Columns may have any names and types, maps included; an empty table gives no rows.
    """
    id_, hash_, row_ = hidden(docs, "id", "hash", "row")
    one = by_ids(docs, copies.where("text_hash IS NULL").select("doc_id"), "left_anti")
    some = copies.where("text_hash IS NOT NULL").select("doc_id", "text_hash").toDF(id_, hash_).distinct()
    n = some.count()
    if n:
        one = one.join(F.broadcast(some) if n <= BROADCAST_IDS else some, (one["doc_id"] == some[id_]) & (F.xxhash64(one["text"].cast("string")) == some[hash_]), "left_anti")
    again = one.groupBy("doc_id", F.xxhash64(F.col("text").cast("string")).alias(hash_)).count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    if again.isEmpty():
        return one
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = by_ids(one, again, "left_semi").groupBy("doc_id", F.col("text").cast("string").alias(hash_)).agg(F.min_by(every, F.to_json(every)).alias(row_))
    return by_ids(one, again, "left_anti").unionByName(repeated.select(*[F.col(row_)[c].alias(c) for c in docs.columns]))
