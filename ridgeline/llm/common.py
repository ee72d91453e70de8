"""What the training-data operators share: work tables in the cluster's shared folder, Arrow text buffers, word hashes.

A *word* is a maximal run of bytes of lower-cased UTF-8 text that are ASCII letters, digits or >= 0x80; everything else separates.
A word's hash is 64 bits and depends on its bytes alone, so it is the same on every executor and in every run.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python works through a batch in pieces of about this many bytes of text, which bounds its memory whatever the batch size.
PIECE_BYTES = 1 << 20


# --- work tables -----------------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode without that setting a temporary one, set for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(base)
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ridgeline-"))
    return spark.sparkContext.getCheckpointDir()


class Work:
    """Tables written to the shared folder while one operator runs; `drop()` removes them once its result no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/work-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        return self.tables([df])

    def tables(self, parts: Iterable[DataFrame]) -> DataFrame:
        """One table of all parts, which have one schema: they run one after another, and the shuffle files of each go before the next one runs."""
        self.n += 1
        path, schema = f"{self.path}/{self.n}", None
        for df in parts:
            schema = schema or df.schema
            with released(self.spark):
                df.write.mode("append").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """While it lasts, a query's shuffle files go when it ends, rather than when the driver happens to collect its garbage: an operator then holds those of
    one step at a time. Each write plans its query anew, so nothing reads them later."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """While it lasts, Arrow batches have at most so many rows: for rows of two whole texts, which may be long, so that a batch fits in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Arrow batches of texts have about so many bytes at most. Spark bounds their rows only, and 10,000 whole texts may be hundreds of MB, several times in the JVM and again in Python.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on this session's Arrow batches have about `most` bytes at most (a longer row comes alone), if its setting allows more. The setting is read
    when a plan runs, which for a lazy result is after its operator has returned, so it stays."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate, which is what a broadcast is decided on."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


# --- Arrow text ------------------------------------------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(offs, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each; a longer text comes alone and whole."""
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = end


# --- word hashes -----------------------------------------------------------------------------------------------------

_M = (1 << 64) - 1


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 of each element."""
    x = x.astype(np.uint64) + np.uint64(_splitmix(seed))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RADIX = 0xD6E8FEB86659FD93
_BYTE = np.array([_splitmix(b + 7) for b in range(256)], np.uint64)
_IS_WORD = np.array([(48 <= b < 58) or (65 <= b < 91) or (97 <= b < 123) or b >= 128 for b in range(256)])
_BYTE[~_IS_WORD] = 0
_BYTE[65:91] = _BYTE[97:123]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS[0].size < n:
        for k, r in enumerate((_RADIX, pow(_RADIX, -1, 1 << 64))):
            p = np.full(max(n, PIECE_BYTES + 4096), r, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and n + 1 offsets of the texts into those. Works in bounded pieces of bytes."""
    if data.size > 2 * PIECE_BYTES:
        parts, at = [], 0
        while at < data.size:
            end = min(at + PIECE_BYTES, data.size)
            while end < data.size and _IS_WORD[data[end]]:  # to the end of a word, or of a text
                stop = np.flatnonzero(~_IS_WORD[data[end : end + 4096]])
                end = min(end + (int(stop[0]) if stop.size else 4096), data.size)
            inner = offsets[(offsets > at) & (offsets < end)] - at
            h, s, e, _ = words_of(data[at:end], np.concatenate([[0], inner, [end - at]]))
            parts.append((h, s + at, e + at))
            at = end
        h, s, e = (np.concatenate(x) for x in zip(*parts))
        return h, s, e, np.searchsorted(s, offsets)
    return words_of(data, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray, inside_of: np.ndarray = _IS_WORD, byte: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = data.size
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(offsets.size, np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = inside_of[data]
    turn = inside[1:] != inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = np.unique(cut[inside[cut] & inside[cut + 1]])  # a text ends within a run
    edges = np.flatnonzero(turn)
    starts, ends = edges[::2], edges[1::2]
    if cut.size:
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    power, inverse = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(byte[data] * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts]), starts, ends, np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words within each text, and their offsets. A text of 1 to k - 1 words gives the one hash of all its words."""
    count = np.diff(offsets)
    if k == 1:
        return h, offsets
    many = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    out = np.zeros(offsets.size, np.int64)
    np.cumsum(many, out=out[1:])
    first = np.repeat(offsets[:-1] - out[:-1], many) + np.arange(out[-1])
    last = np.repeat(offsets[1:], many)
    x = np.zeros(first.size, np.uint64)
    for j in range(k):
        p = first + j
        y = h[np.minimum(p, h.size - 1)] if h.size else x
        ok = p < last
        x = np.where(ok, mix(x * np.uint64(0x9E3779B97F4A7C15) + y), x)
    return x, out


#: Up to so many ids (about 16 bytes each) are broadcast to pick or drop their rows; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Rows of `docs` that have (left_semi) or lack (left_anti) their key among the one column of `ids`. Rows with a null key lack it."""
    (own,) = hidden(docs, "id")
    ids = ids.toDF(own).distinct()
    ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    return docs.join(ids, docs[key] == ids[own], how)


def hidden(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that no column of `docs` has, whatever those are called."""
    mark = uuid.uuid4().hex[:12]
    return [f"_{n}_{mark}" for n in names]


def units(docs: DataFrame, work: Work, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one id for each different text, and (unit, id) of the texts that share their doc_id with others (None: there are none).

    A doc_id names its text, of several the least in order. Others under the same doc_id get numbers from 2^62 on, which depend on doc_id and text
    alone, so that they count as later than all others. Rows without a doc_id or a text are left out.
    """
    texts = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hashed = F.xxhash64("text")
    several = work.table(texts.groupBy("doc_id").agg(F.min(hashed).alias("_a"), F.max(hashed).alias("_b")).where("_a <> _b").select("doc_id"))
    if several.isEmpty():
        return texts, None
    shared = work.table(by_ids(texts, several, "left_semi").groupBy("doc_id").agg(F.xxhash64(F.min("text"))).toDF("_shared", "_least"))
    n = shared.count()
    unit = F.xxhash64("doc_id", "text", F.lit(7)).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    marked = texts.join(F.broadcast(shared) if n <= BROADCAST_IDS else shared, F.col("doc_id") == F.col("_shared"), "left")
    marked = marked.select(F.when(F.coalesce(F.col("_least") == hashed, F.lit(True)), F.col("doc_id")).otherwise(unit).alias("doc_id"), "text", "_shared")
    return marked.select("doc_id", "text"), work.table(marked.where("_shared IS NOT NULL").select(F.col("doc_id").alias("unit"), F.col("_shared").alias("id")).distinct())


def named(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """`df` with the doc_ids in the place of the units in `columns`."""
    for c in columns if names is not None else ():
        small = names.toDF("_unit", "_name")
        df = df.join(small, df[c] == small["_unit"], "left").withColumn(c, F.coalesce("_name", c)).drop("_unit", "_name")
    return df


def lowered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the lower-cased text: what the hashing operators read. `docs` may have any other columns."""
    return docs.select(F.col(key).cast("long").alias(key), F.lower(F.col(text)).alias("text"))
