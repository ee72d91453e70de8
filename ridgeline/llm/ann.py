"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

A vector (scaled to unit length) belongs to its nearest coarse centroid; what is left is quantised in `parts` pieces of few dimensions, a byte
each. A query reads the lists of the centroids nearest to it: by tables of its products with every piece's codewords, a code's similarity is a
sum of table entries. All codes that may be among the k nearest, as far off as codes are, are compared exactly. How many lists to read is found from queries whose
true neighbours are computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import Work, shared_dir


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten()).astype(np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centroids by Lloyd's rounds from random rows; a centroid left without rows starts again from a random row. Fewer rows than k: rows repeat."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]] if len(x) >= k else x[np.arange(k) % len(x)]
    c = c.astype(np.float32).copy()
    for _ in range(rounds if len(x) > k else 0):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)]).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Quantiser:
    centroids: np.ndarray  # lists x dims
    words: np.ndarray  # parts x 256 x dims of a part, padded with zeros
    width: int

    def split(self, x: np.ndarray) -> np.ndarray:
        parts = self.words.shape[0]
        return np.pad(x, ((0, 0), (0, parts * self.width - x.shape[1]))).reshape(len(x), parts, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(x, self.centroids)
        r = self.split(x - self.centroids[lists])
        return lists, np.stack([nearest(r[:, p], self.words[p]) for p in range(r.shape[1])], 1).astype(np.uint8)

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Length of what the codes leave out of each vector."""
        r = self.split(x - self.centroids[lists])
        for p in range(r.shape[1]):
            r[:, p] -= self.words[p][codes[:, p]]
        return np.sqrt((r * r).sum(axis=(1, 2)))

    def probes(self, q: np.ndarray) -> np.ndarray:
        """Lists in the order of their centroids' distance to each query."""
        return np.argsort((self.centroids * self.centroids).sum(1) / 2 - q @ self.centroids.T, axis=1, kind="stable")

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x parts x 256 products of the query with each codeword."""
        return np.einsum("qpd,pwd->qpw", self.split(q), self.words, optimize=True).astype(np.float32)


def fit(sample: np.ndarray, lists: int, parts: int, seed: int = 3) -> Quantiser:
    parts = min(parts, sample.shape[1])
    width = -(-sample.shape[1] // parts)
    z = Quantiser(kmeans(sample, lists, 8, seed), np.zeros((parts, 256, width), np.float32), width)
    r = z.split(sample - z.centroids[nearest(sample, z.centroids)])
    z.words = np.stack([kmeans(r[:CODEWORD_ROWS, p], 256, 6, seed + p) for p in range(parts)])
    return z


def scan(tables: np.ndarray, base: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """queries x codes similarities: the query's product with the list's centroid plus its tables' entries."""
    s = np.repeat(base[:, None], len(codes), axis=1).astype(np.float32)
    for p in range(codes.shape[1]):
        s += tables[:, p].take(codes[:, p], axis=1)
    return s


def _worth(best: np.ndarray, s: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which codes may be among a query's nearest: their estimate plus margin reaches the least of `best`, the greatest estimates less margin so far,
    which are returned anew."""
    low = s - margin
    k = best.shape[1]
    top = low if low.shape[1] <= k else np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k :]
    both = np.concatenate([best, top], axis=1)
    best = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
    return s + margin >= best.min(axis=1, keepdims=True), best


def _scan_local(batches: Iterator[pa.RecordBatch], z: Quantiser, index: dict, probes: int, k: int) -> Iterator[pa.RecordBatch]:
    """Every query against all its lists, which are at hand."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            b = batch.slice(at, 64)
            q, ids = _matrix(b.column(1)), np.asarray(b.column(0))
            near = z.probes(q)[:, :probes]
            tables, base, length = z.tables(q), q @ z.centroids.T, np.linalg.norm(q, axis=1, keepdims=True)
            wanted = np.zeros((len(q), len(z.centroids)), bool)
            np.put_along_axis(wanted, near, True, axis=1)
            best = np.full((len(q), k), -np.inf, np.float32)
            held: list[tuple] = []
            for c in np.argsort(-wanted.sum(axis=0), kind="stable"):
                if not wanted[:, c].any() or int(c) not in index:
                    continue
                vid, codes, margin = index[int(c)]
                rows = np.flatnonzero(wanted[:, c])
                for lo in range(0, len(vid), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    s, m = scan(tables[rows], base[rows, c], codes[part]), margin[None, part] * length[rows]
                    ok, best[rows] = _worth(best[rows], s, m)
                    i, j = np.nonzero(ok)
                    held.append((rows[i], vid[part][j], (s + m)[i, j]))
                if sum(h[0].size for h in held) > 2_000_000:
                    held = [_still(held, best)]
            qi, v, _ = _still(held, best)
            yield pa.RecordBatch.from_arrays([pa.array(ids[qi].astype(np.int64)), pa.array(v.astype(np.int64))], ["q", "v"])


def _still(held: list[tuple], best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes that reach the bound as it is now."""
    qi, v, high = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    ok = high >= best.min(axis=1)[qi]
    return qi[ok], v[ok], high[ok]


def _scan_group(key, queries: pa.Table, codes: pa.Table, z: Quantiser, k: int) -> pa.Table:
    """The queries that read one piece of a list against its codes."""
    out = []
    vid = np.asarray(codes.column("vec_id").combine_chunks())
    code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(len(vid), -1)
    margin = np.asarray(codes.column("margin").combine_chunks())
    for at in range(0, queries.num_rows if len(vid) else 0, 64):
        b = queries.slice(at, 64)
        q, ids = _matrix(b.column("v")), np.asarray(b.column("q").combine_chunks())
        s, m = scan(z.tables(q), q @ z.centroids[key[0].as_py()], code), margin[None, :] * np.linalg.norm(q, axis=1, keepdims=True)
        ok, _ = _worth(np.full((len(q), k), -np.inf, np.float32), s, m)
        i, j = np.nonzero(ok)
        out.append((ids[i], vid[j], (s - m)[i, j], (s + m)[i, j]))
    q, v, low, high = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),) * 2
    return pa.table({"q": q.astype(np.int64), "v": v.astype(np.int64), "low": low.astype(np.float32), "high": high.astype(np.float32)})


def _true_lists(batches: Iterator[pa.RecordBatch], z: Quantiser, q: np.ndarray, ids: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Of each batch, the k vectors most similar to each sampled query, with the rank of their list among the query's."""
    rank = np.argsort(z.probes(q), axis=1)
    for b in batches:
        x, vid = _matrix(b.column(1)), np.asarray(b.column(0))
        if not len(x):
            continue
        s = q @ x.T
        s[ids[:, None] == vid[None, :]] = -2
        m = min(k, s.shape[1])
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        lists = nearest(x, z.centroids)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), m)), pa.array(vid[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel().astype(float)), pa.array(np.take_along_axis(rank, lists[top], 1).ravel())], ["i", "v", "s", "rank"])


def _rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = (_matrix(b.column(2)).astype(float) * _matrix(b.column(3))).sum(1) if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["q", "v", "s"])


def _rerank_local(batches: Iterator[pa.RecordBatch], ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 16):
            b = batch.slice(at, 1 << 16)
            i, j = (np.searchsorted(ids, np.asarray(b.column(c))) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x[i].astype(float) * x[j]).sum(1))], ["q", "v", "s"])


#: Up to so many bytes, codes or vectors are broadcast; beyond, queries go to the lists they read by a shuffle, and candidates to their vectors.
BROADCAST_BYTES = 64 << 20


#: Rows of the sample that the codewords are learned from.
CODEWORD_ROWS = 32_768


def neighbours(table: DataFrame, k: int = 10, asked: Column | None = None, key: str = "vec_id", column: str = "embedding", parts: int = 32, margin: float = 3.0, recall: float = 0.97, calibrate: int = 512, sample: int = 262_144, shard: int = 50_000, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(vec_id, neighbour_id, rank, similarity): for every row that `asked`, a condition, holds of (by default all), its k most cosine-similar other
    rows of the whole table, by similarity, then id.

    There are about sqrt(n) lists, but one for 16 rows of the sample at most; long lists are searched in shards of about `shard` codes. Centroids are learned
    from 64 vectors a list, `sample` in all at most, and codewords from 32,768 of those at most; every row is indexed. `recall` sets how many lists are
    read: so many that they hold this share of the true neighbours of `calibrate` queries, which are compared with all vectors. Vectors without structure
    need most of the lists; clustered ones few. An estimate is off by about the length of what the code leaves out over the root of the dimensions; `margin` times
    that either way decides which codes may be among the k nearest, and all of these are compared exactly, however many. Equal vectors are searched for once.

    Null keys, null or empty vectors and vectors holding nulls or nan aren't searched or found. Vectors are compared with those of their own length.
    Of rows that repeat a key, the one with the least vector counts. Zero vectors have similarity 0. With k or fewer other rows, there are fewer
    neighbours; an empty table gives no rows. Other columns aren't read.
    """
    spark = table.sparkSession
    shared_dir(spark)
    work = Work(spark)
    wanted = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    x = table.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<float>").alias("v"), wanted.alias("asked")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, e -> e IS NULL OR isnan(e))")
    x = work.table(x.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asked").alias("asked")))
    dims = [r.d for r in x.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    out = None
    for d in dims:
        own = _of_one_length(x.where(F.size("v") == d) if len(dims) > 1 else x, d, work, k, parts, margin, recall, calibrate, sample, shard, broadcast_bytes)
        out = own if out is None else out.unionAll(own)
    if out is None:
        return spark.createDataFrame([], f"{key} long, neighbour_id long, rank int, similarity double")
    out = out.select(F.col("vec_id").alias(key), "neighbour_id", "rank", "similarity").checkpoint()
    work.drop()
    return out


def _of_one_length(every: DataFrame, d: int, work: Work, k: int, parts: int, margin: float, recall: float, calibrate: int, most: int, shard: int, broadcast_bytes: int) -> DataFrame:
    spark = every.sparkSession
    hashed = [F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2")]
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    first = work.table(every.select(*hashed, "vec_id").withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1))  # each task's first alone are shuffled
    x = work.table(every.select(*hashed, "v", "vec_id", "asked").groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.first("v").alias("v"), F.max("asked").alias("asked")))
    n = x.count()
    lists = int(max(1, min(round(n**0.5), most // 16)))
    chosen = x.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(min(64 * lists, most)).select("vec_id", "v").toPandas()
    rows = np.stack(chosen["v"].to_numpy()).astype(np.float32)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)
    z = fit(rows, lists, parts)
    shared = spark.sparkContext.broadcast(z)
    tried, tried_ids = rows[:calibrate], chosen["vec_id"].to_numpy()[:calibrate]
    true = x.select("vec_id", "v").mapInArrow(lambda it: _true_lists(it, shared.value, tried, tried_ids, k), "i long, v long, s double, rank long")
    ranks = true.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "v"))).where(f"r <= {k} AND s > -2").select("rank").toPandas()["rank"].to_numpy()
    probes = int(np.sort(ranks)[min(ranks.size - 1, int(np.ceil(recall * ranks.size)) - 1)]) + 1 if ranks.size else 1

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = _matrix(b.column(1)) if b.num_rows else np.zeros((0, d), np.float32)
            at, codes = shared.value.encode(v)
            wide = margin / d**0.5 * shared.value.errors(v, at, codes) + 1e-6
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(wide.astype(np.float32))], ["vec_id", "list", "code", "margin"])

    codes = work.table(x.select("vec_id", "v").mapInArrow(encode, "vec_id long, list int, code binary, margin float"))
    queries = x.where("asked").select("vec_id", "v")
    if n * (parts + 16) <= broadcast_bytes:
        c = codes.toPandas()
        index = {int(g): (part["vec_id"].to_numpy(), np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1), part["margin"].to_numpy()) for g, part in c.groupby("list")}
        held = spark.sparkContext.broadcast(index)
        cores = max(2, spark.sparkContext.defaultParallelism)
        candidates = queries.repartition(2 * cores).mapInArrow(lambda it: _scan_local(it, shared.value, held.value, probes, k + 1), "q long, v long")
    else:
        shards = F.greatest(F.lit(1), F.ceil(F.col("n") / shard)).cast("int")
        sizes = codes.groupBy("list").agg(F.count("*").alias("n")).select("list", shards.alias("shards"))
        codes = codes.join(F.broadcast(sizes), "list").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).drop("shards")

        def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                near = shared.value.probes(_matrix(b.column(1)))[:, :probes] if b.num_rows else np.zeros((0, 1), int)
                take = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(near.ravel().astype(np.int32))], ["q", "v", "list"])

        own = F.broadcast(sizes.toDF("to", "pieces"))  # one row a list
        asking = queries.mapInArrow(route, "q long, v array<float>, to int").join(own, "to").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
        found = asking.groupBy("to", "piece").cogroup(codes.groupBy("list", "shard")).applyInArrow(lambda key_, a, b: _scan_group(key_, a, b, shared.value, k + 1), "q long, v long, low float, high float")
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low"))))
        bound = F.max(F.when(F.col("r") == k + 1, F.col("low"))).over(Window.partitionBy("q"))
        candidates = found.withColumn("bound", bound).where("bound IS NULL OR high >= bound").select("q", "v")
    if n * (4 * d + 8) <= broadcast_bytes:
        v = x.select("vec_id", "v").toPandas().sort_values("vec_id")
        m = np.stack(v["v"].to_numpy()).astype(np.float32)
        vectors = spark.sparkContext.broadcast((v["vec_id"].to_numpy(), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)))
        exact = candidates.mapInArrow(lambda it: _rerank_local(it, *vectors.value), "q long, v long, s double")
    else:
        one, two = x.select("vec_id", "v").toDF("q", "vq"), x.select("vec_id", "v").toDF("v", "vv")
        exact = candidates.join(one, "q").join(two, "v").select("q", "v", "vq", "vv").mapInArrow(_rerank, "q long, v long, s double")
    exact = exact.withColumn("s", F.round("s", 6))
    # each found vector stands for its first k + 1 rows; of these, k + 1 in all are enough for each row with the query's vector
    lead = work.table(exact.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "v"))).where(f"r <= {k + 1}").drop("r"))
    named = x.select("h1", "h2", F.col("vec_id").alias("unit"))
    members = named.join(first.select("h1", "h2", "vec_id"), ["h1", "h2"]).select(F.col("unit").alias("v"), F.col("vec_id").alias("neighbour_id"))
    lead = lead.join(members, "v").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "neighbour_id"))).where(f"r <= {k + 1}")
    rows_asked = every.where("asked").select(*hashed, "vec_id").join(named, ["h1", "h2"]).select("vec_id", F.col("unit").alias("q"))
    each = rows_asked.join(lead, "q").where("vec_id <> neighbour_id")
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy("r"))).where(f"rank <= {k}")
    return each.select("vec_id", "neighbour_id", "rank", F.col("s").alias("similarity"))
