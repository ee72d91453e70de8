"""Kernels, landmarks, Nystrom embeddings, normal equations and ridge solutions.

Rows are embedded by their kernel with m landmarks, times the inverse of the landmarks' Cholesky factor. Only the landmarks (m rows, m <= MOST_LANDMARKS)
and m x m sums come to the driver; rows stay where they are and meet the broadcast landmarks in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_LANDMARKS = 32768
TILE = 4096


# --- kernels ---------------------------------------------------------------------------------------------------------


def kernel(c, kind: str = "cosine", nu: int = 3, gamma: float = 1.0):
    """A kernel's value from a cosine: of a Column or a numpy array. nu: 0, 1, 2 for Matern 1/2, 3/2, 5/2; 3 for the Gaussian limit."""
    col = isinstance(c, Column)
    exp, sqrt = (F.exp, F.sqrt) if col else (np.exp, np.sqrt)
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) if col else np.clip(c, -1.0, 1.0)
    if kind == "cosine":
        return c
    if kind != "matern" or nu not in (0, 1, 2, 3):
        raise ValueError(f"no kernel {kind} {nu}")
    if nu == 3:
        return exp(-gamma * (1 - c))
    d = 2 * (1 - c) * gamma
    a = sqrt((2 * nu + 1) * d)
    return exp(-a) * (1 if nu == 0 else 1 + a if nu == 1 else 1 + a + a * a / 3)


def sparse_dot(x: DataFrame, z: DataFrame) -> DataFrame:
    """(row, landmark, dot) of two sparse matrices that share columns, for pairs that share any. z is the small side."""
    zz = z.select(F.col("row").alias("landmark"), "col", F.col("val").cast("double").alias("_z"))
    return x.join(zz, "col").groupBy("row", "landmark").agg(F.sum(F.col("val").cast("double") * F.col("_z")).alias("dot"))


def dense_dot(x: DataFrame, z: DataFrame, key: str, code: str) -> DataFrame:
    """(key, landmark, dot) of every row of x with every row of z, by array functions; z is broadcast and has MOST_LANDMARKS rows at most."""
    if z.count() > MOST_LANDMARKS:
        raise ValueError(f"at most {MOST_LANDMARKS} landmarks")
    zz = z.select(F.col(key).alias("landmark"), F.col(code).alias("_z"))
    product = F.aggregate(F.zip_with(code, "_z", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return x.select(key, code).crossJoin(F.broadcast(zz)).select(key, "landmark", product.alias("dot"))


# --- landmarks -------------------------------------------------------------------------------------------------------


def fingerprint(x: DataFrame, code: str) -> DataFrame:
    """x with fp, equal for rows of equal vectors."""
    return x.withColumn("fp", F.xxhash64(code))


def first_of_equals(x: DataFrame, code: str, key: str) -> DataFrame:
    """The row with the least key of each distinct vector."""
    return x.withColumn("_r", F.row_number().over(Window.partitionBy(code).orderBy(key))).where("_r = 1").drop("_r")


def quotas(sizes: list[int], m: int) -> list[int]:
    """m in proportion to the sizes, in whole numbers by largest remainders (the first of equals)."""
    n = sum(sizes)
    m = min(m, n)
    exact = [m * s / n for s in sizes] if n else [0.0] * len(sizes)
    out = [math.floor(x) for x in exact]
    for i in sorted(range(len(sizes)), key=lambda i: (out[i] - exact[i], i))[: m - sum(out)]:
        out[i] += 1
    return out


def landmarks(x: DataFrame, key: str, m: int, code: str | None = None, seed: int = 1, strata: str | None = None) -> DataFrame:
    """m rows of x in a seeded order, of distinct vectors if `code` names them; of each stratum in proportion to its rows."""
    if m > MOST_LANDMARKS:
        raise ValueError(f"at most {MOST_LANDMARKS} landmarks")
    x = first_of_equals(x, code, key) if code else x
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    if strata is None:
        return x.withColumn("_o", order).orderBy("_o", key).limit(m).drop("_o")
    sizes = x.groupBy(strata).agg(F.count("*").alias("n")).orderBy(strata).collect()
    plan = x.sparkSession.createDataFrame([(r[0], q) for r, q in zip(sizes, quotas([r["n"] for r in sizes], m))], f"_s {dict(x.dtypes)[strata]}, _q int")
    r = F.row_number().over(Window.partitionBy(strata).orderBy(order, key))
    most = max([q for q in quotas([r_["n"] for r_ in sizes], m)], default=0)
    y = x.withColumn("_r", r).where(F.col("_r") <= most)  # a constant, so that each task sends on no more than so many of a stratum
    return y.join(F.broadcast(plan), y[strata].eqNullSafe(plan["_s"])).where("_r <= _q").drop("_r", "_s", "_q")


# --- Nystrom ---------------------------------------------------------------------------------------------------------


def factor(k: np.ndarray) -> np.ndarray:
    """Lower Cholesky factor of k plus as little of the identity as it takes: 1e-6, ten times more at each failure, up to 0.1."""
    jitter = 1e-6
    while True:
        try:
            return np.linalg.cholesky(k + jitter * np.eye(len(k)))
        except np.linalg.LinAlgError:
            jitter *= 10
            if jitter > 0.1:
                raise


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _dense(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, d) if len(column) else np.zeros((0, d))


@dataclass
class Encoder:
    """Landmark vectors (unit length, m x d) and the inverse factor. For sparse rows, `columns` names the d columns that any landmark has,
    and `scale` weighs all columns; other columns count for a row's length only."""

    z: np.ndarray
    inverse: np.ndarray
    kind: str = "cosine"
    nu: int = 3
    gamma: float = 1.0
    columns: np.ndarray | None = None

    @property
    def dims(self) -> int:
        return len(self.z)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit-length rows."""
        return kernel(x @ self.z.T, self.kind, self.nu, self.gamma) @ self.inverse.T

    def encode(self, x: DataFrame, key: str, code: str) -> DataFrame:
        """(key, code): embeddings of dense rows; null vectors have null codes."""
        kind, d = dict(x.dtypes)[key], self.z.shape[1]
        shared = x.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, TILE):
                    b = batch.slice(at, TILE)
                    null = np.asarray(b.column(1).is_null())
                    c = np.zeros((b.num_rows, self_dims), np.float32)
                    c[~null] = shared.value.codes(_unit(_dense(b.column(1).filter(pa.array(~null)), d)))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, self_dims, dtype=np.int32)), pa.array(c.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0), lists if not null.any() else pa.array([None if n else r for n, r in zip(null, c)], pa.list_(pa.float32()))], [key, "code"])

        self_dims = self.dims
        return x.select(key, F.col(code).cast("array<double>").alias("code")).mapInArrow(run, f"{key} {kind}, code array<float>")

    def encode_wide(self, x: DataFrame, key: str = "row") -> DataFrame:
        """(key, code) of sparse rows (key, cols, vals); an empty row's kernel is that of a cosine of 0."""
        if self.columns is None:
            raise ValueError("this encoder takes dense rows")
        kind, m = dict(x.dtypes)[key], self.dims
        shared = x.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    b, own = batch.slice(at, 256), shared.value
                    n = np.diff(np.asarray(b.column(1).fill_null([]).offsets if b.column(1).null_count else b.column(1).offsets))
                    row = np.repeat(np.arange(b.num_rows), n)
                    cols, vals = np.asarray(b.column(1).flatten()), np.asarray(b.column(2).flatten()).astype(float)
                    length = np.sqrt(np.bincount(row, vals * vals, b.num_rows))
                    p = np.minimum(np.searchsorted(own.columns, cols), max(own.columns.size - 1, 0))
                    ok = own.columns[p] == cols if own.columns.size else np.zeros(cols.size, bool)
                    d = np.zeros((b.num_rows, own.columns.size))
                    np.add.at(d, (row[ok], p[ok]), vals[ok])
                    d = np.divide(d, length[:, None], out=np.zeros_like(d), where=length[:, None] > 0)
                    c = own.codes(d).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, m, dtype=np.int32)), pa.array(c.ravel()))], [key, "code"])

        return x.select(key, F.col("cols").cast("array<int>").alias("cols"), F.col("vals").cast("array<double>").alias("vals")).mapInArrow(run, f"{key} {kind}, code array<float>")


def nystrom_dense(z: DataFrame, key: str, code: str, kind: str = "cosine", nu: int = 3, gamma: float = 1.0) -> Encoder | None:
    """An encoder by the landmark rows z; None without any."""
    rows = z.select(key, F.col(code).cast("array<double>").alias("v")).orderBy(key).toPandas()["v"]
    if not len(rows):
        return None
    x = _unit(np.stack(rows.to_numpy()))
    return Encoder(x, np.linalg.inv(factor(kernel(x @ x.T, kind, nu, gamma))), kind, nu, gamma)


def nystrom_sparse(z: DataFrame, kind: str = "cosine", nu: int = 3, gamma: float = 1.0) -> Encoder | None:
    """An encoder by the landmark rows of a sparse matrix (row, col, val), already weighted; None without any."""
    t = z.select("row", "col", F.col("val").cast("double").alias("val")).toPandas()
    if not len(t):
        return None
    columns, j = np.unique(t["col"].to_numpy(), return_inverse=True)
    rows, i = np.unique(t["row"].to_numpy(), return_inverse=True)
    x = np.zeros((rows.size, columns.size))
    np.add.at(x, (i, j), t["val"].to_numpy())
    x = _unit(x)
    return Encoder(x, np.linalg.inv(factor(kernel(x @ x.T, kind, nu, gamma))), kind, nu, gamma, columns)


# --- normal equations ------------------------------------------------------------------------------------------------


@dataclass
class Gram:
    """Sums over rows: codes x codes, codes x targets, codes, targets, and how many rows."""

    xx: np.ndarray
    xy: np.ndarray
    x: np.ndarray
    y: np.ndarray
    n: int

    def less(self, other: "Gram") -> "Gram":
        """The sums without another's: leaves a fold out without another pass over the rows."""
        return Gram(self.xx - other.xx, self.xy - other.xy, self.x - other.x, self.y - other.y, self.n - other.n)

    def solve(self, ridge: float) -> tuple[np.ndarray, np.ndarray]:
        """Weights and intercept of ridge regression on centred sums; the penalty is relative to their mean eigenvalue."""
        if not self.n:
            return np.zeros_like(self.xy), np.zeros(self.xy.shape[1])
        c, t = self.x / self.n, self.y / self.n
        a = self.xx - self.n * np.outer(c, c)
        b = self.xy - self.n * np.outer(c, t)
        mean = max(float(np.trace(a)) / max(len(a), 1), 0.0)
        j = 1e-6
        for _ in range(8):
            try:
                low = np.linalg.cholesky(a + (ridge * mean + mean * j + j) * np.eye(len(a)))
                w = np.linalg.solve(low.T, np.linalg.solve(low, b))
                return w, t - w.T @ c
            except np.linalg.LinAlgError:
                j *= 16
        raise np.linalg.LinAlgError("the normal equations can't be factored")


def grams(codes: DataFrame, n_labels: int, key: str = "row", label: str | None = "labels", target: str | None = None, fold: str | None = None) -> dict[int, Gram]:
    """Sums of each fold (of fold -1 without folds), in one pass: a partial matrix for each task and fold, added up by 32
    tasks and then the driver.

    codes: (key, code, labels array<int> or a target array<double> or number[, fold]).
    """
    y = F.col(target) if target else F.col(label)
    kind = dict(codes.dtypes)[target or label]
    y = y if kind.startswith("array") else F.array(y)
    x = codes.where("code IS NOT NULL").select(F.col("code").cast("array<double>").alias("code"), (y.cast("array<double>") if target else y.cast("array<int>")).alias("y"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Gram] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                b = batch.slice(at, TILE)
                c = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
                t = np.zeros((b.num_rows, n_labels))
                offs = np.asarray(b.column(1).offsets)
                flat = np.asarray(b.column(1).flatten())
                if target:
                    t = flat.reshape(b.num_rows, n_labels).astype(float)
                else:
                    row = np.repeat(np.arange(b.num_rows), np.diff(offs)) if not b.column(1).null_count else np.concatenate([np.full(len(v.as_py() or []), i) for i, v in enumerate(b.column(1))]).astype(int)
                    ok = (flat >= 0) & (flat < n_labels)
                    t[row[ok], flat[ok]] = 1
                f = np.asarray(b.column(2))
                for k in np.unique(f):
                    i = f == k
                    g = Gram(c[i].T @ c[i], c[i].T @ t[i], c[i].sum(0), t[i].sum(0), int(i.sum()))
                    h = held.get(int(k))
                    held[int(k)] = g if h is None else Gram(h.xx + g.xx, h.xy + g.xy, h.x + g.x, h.y + g.y, h.n + g.n)
        for k, g in held.items():
            yield _gram_row(k, g)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Gram] = {}
        for b in batches:
            for r in b.to_pylist():
                _add(held, r)
        for k, g in held.items():
            yield _gram_row(k, g)

    schema = "fold int, n long, d int, l int, sums binary"
    # one sum a task and fold, added up in 32 tasks: what comes to the driver doesn't grow with the rows
    parts = x.mapInArrow(run, schema).repartition(32).mapInArrow(add, schema)
    out: dict[int, Gram] = {}
    for r in parts.toLocalIterator():
        _add(out, r)
    return out


def _gram_row(k: int, g: Gram) -> pa.RecordBatch:
    raw = np.concatenate([g.xx.ravel(), g.xy.ravel(), g.x, g.y]).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([g.n], pa.int64()), pa.array([g.x.size], pa.int32()), pa.array([g.y.size], pa.int32()), pa.array([raw], pa.binary())], ["fold", "n", "d", "l", "sums"])


def _add(held: dict[int, Gram], r) -> None:
    d, lab = r["d"], r["l"]
    v = np.frombuffer(r["sums"], float)
    a, b = d * d, d * d + d * lab
    g = Gram(v[:a].reshape(d, d), v[a:b].reshape(d, lab), v[b : b + d], v[b + d :], r["n"])
    h = held.get(r["fold"])
    held[r["fold"]] = g if h is None else Gram(h.xx + g.xx, h.xy + g.xy, h.x + g.x, h.y + g.y, h.n + g.n)


def total(parts: dict[int, Gram]) -> Gram:
    out = None
    for g in parts.values():
        out = g if out is None else Gram(out.xx + g.xx, out.xy + g.xy, out.x + g.x, out.y + g.y, out.n + g.n)
    if out is None:
        raise ValueError("no rows")
    return out


def gram_long(x: DataFrame, key: str, code: str, dims: int, fold: str | None = None) -> DataFrame:
    """([fold,] i, j, s): sums of products of the first `dims` dimensions, i <= j, in SQL: for few dimensions, and to check the others by."""
    base = x.select(*([fold] if fold else []), F.transform(F.slice(code, 1, dims), lambda v: v.cast("double")).alias("c"))
    pairs = [F.sum(F.col("c")[i] * F.col("c")[j]).alias(f"s_{i}_{j}") for i in range(dims) for j in range(i, dims)]
    agg = base.groupBy(*([fold] if fold else [])).agg(*pairs)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s_{i}_{j}").alias("s")) for i in range(dims) for j in range(i, dims)]))
    return agg.select(*([fold] if fold else []), cells.alias("p")).select(*([fold] if fold else []), "p.i", "p.j", "p.s")


# --- ridge -----------------------------------------------------------------------------------------------------------


@dataclass
class Ridge:
    w: np.ndarray  # dims x labels
    b: np.ndarray

    @staticmethod
    def from_gram(g: Gram, ridge: float) -> "Ridge":
        return Ridge(*g.solve(ridge))

    def regress(self, codes: DataFrame, key: str = "row") -> DataFrame:
        """(key, scores): all labels' scores."""
        kind = dict(codes.dtypes)[key]
        shared = codes.sparkSession.sparkContext.broadcast(self)
        n = self.b.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, TILE):
                    b = batch.slice(at, TILE)
                    s = (np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1) @ shared.value.w + shared.value.b).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, n, dtype=np.int32)), pa.array(s.ravel()))], [key, "scores"])

        return codes.where("code IS NOT NULL").select(key, F.col("code").cast("array<double>").alias("code")).mapInArrow(run, f"{key} {kind}, scores array<float>")

    def label(self, codes: DataFrame, k: int, key: str = "row") -> DataFrame:
        """(key, rank, label, score): the k best labels of each row by score, then label."""
        return top_scores(self.regress(codes, key), max(1, min(k, self.b.size)), key)


def top_scores(scores: DataFrame, k: int, key: str = "row") -> DataFrame:
    """The k best entries of a score array, within the row: no shuffle."""
    pairs = F.transform("scores", lambda s, i: F.struct((-s).alias("n"), i.alias("label"), s.alias("score")))
    best = F.slice(F.array_sort(pairs), 1, k)
    return scores.select(key, F.posexplode(best).alias("rank", "p")).select(key, (F.col("rank") + 1).alias("rank"), F.col("p.label").alias("label"), F.col("p.score").alias("score"))


def long_scores(scores: DataFrame, key: str = "row") -> DataFrame:
    return scores.select(F.col(key).alias("row"), F.posexplode("scores").alias("label", "score"))
