"""Long-form containers: sparse matrices (row, col, val), blocks of them, and span sets (doc_id, idx, s, e, ...).

Rows are named by an id column, never by position; where an order is part of the meaning, it is a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validate(df: DataFrame, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """`df` itself, if it has the columns with one of the given types each; else a ValueError that names what is wrong."""
    have = dict(df.dtypes)
    for name, kinds in columns.items():
        if name not in have:
            raise ValueError(f"no column {name}; there are {', '.join(have)}")
        if kinds and have[name] not in kinds:
            raise ValueError(f"{name} is {have[name]}, not {' or '.join(kinds)}")
    return df


#: Rows of a short table that are broadcast.
SHORT = 1_000_000


def short(df: DataFrame, most: int = SHORT) -> DataFrame:
    """`df`, to be broadcast if it has no more rows than that, and else to be joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def spans(df: DataFrame, *more: str) -> DataFrame:
    return validate(df, {"doc_id": (), "s": ("bigint", "int"), "e": ("bigint", "int")} | dict.fromkeys(more, ()))


def from_classes(df: DataFrame, label: str, row: str = "row") -> DataFrame:
    """One entry for each row: its class as the column. Null classes are empty rows."""
    return df.where(F.col(label).isNotNull()).select(row, F.col(label).cast("int").alias("col"), F.lit(1.0).alias("val"))


def from_mask(df: DataFrame, mask: str, row: str = "row") -> DataFrame:
    """Column 0 for rows whose mask is true."""
    return df.where(mask).select(row, F.lit(0).alias("col"), F.lit(1.0).alias("val"))


def gather(x: DataFrame, ids: DataFrame, row: str = "row") -> DataFrame:
    """Rows of x named in ids (row, new_row), under their new names; a row named twice comes twice."""
    return x.join(ids, row).drop(row).withColumnRenamed("new_row", row).select(x.columns)


def append(a: DataFrame, b: DataFrame, n_a: int, row: str = "row") -> DataFrame:
    """b's rows after a's n_a rows."""
    return a.unionByName(b.withColumn(row, F.col(row) + n_a))


def hcat(blocks: list[tuple[DataFrame, int]]) -> DataFrame:
    """Blocks (matrix, number of its columns) side by side: one matrix, each block's columns after those before it."""
    at, parts = 0, []
    for x, n in blocks:
        parts.append(x.withColumn("col", F.col("col") + at))
        at += n
    return reduce(DataFrame.unionByName, parts)


def to_wide(x: DataFrame, row: str = "row") -> DataFrame:
    """(row, cols, vals) arrays in the order of the columns."""
    pairs = F.array_sort(F.collect_list(F.struct("col", "val")))
    return x.groupBy(row).agg(pairs.alias("_p")).select(row, F.col("_p.col").alias("cols"), F.col("_p.val").alias("vals"))


def to_long(x: DataFrame, row: str = "row") -> DataFrame:
    return x.select(row, F.explode(F.arrays_zip("cols", "vals")).alias("_p")).select(row, F.col("_p.cols").alias("col"), F.col("_p.vals").alias("val"))


def dense_to_sparse(x: DataFrame, code: str = "code", row: str = "row") -> DataFrame:
    """Non-zero entries of a dense vector column."""
    return x.select(row, F.posexplode(code).alias("col", "val")).where("val <> 0")


def _monotone(df: DataFrame, c: str):
    """A number that never falls as the column's value rises, to cut ranges by."""
    kind = dict(df.dtypes)[c]
    if kind in ("string", "binary"):
        raw = F.col(c) if kind == "binary" else F.encode(F.col(c), "utf-8")
        return F.conv(F.rpad(F.hex(F.substring(raw, 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(c).cast("double")


def ranked(df: DataFrame, name: str, order: list[str], by: list[str] | None = None, sums: dict[str, str] | None = None, buckets: int = 1024) -> DataFrame:
    """`df` with `name`, each row's place from 0 in the ascending order of the columns (within `by`), and running sums up to and with the row.

    sums: new column -> column that is summed. Rows are cut into ranges of the first ordering column at its approximate quantiles; places and
    sums are taken within a range and shifted by the totals of the ranges before it, so no task orders more than a range. The result
    doesn't depend on where the cuts are. Nulls come first; NaN last.
    """
    by, sums = by or [], sums or {}
    x = df.withColumn("_ranked_m", _monotone(df, order[0]))
    side = max(2, round(buckets**0.5))
    cuts = x.agg(F.percentile_approx("_ranked_m", [i / (side * side) for i in range(1, side * side)], 10_000)).first()[0]
    cuts = sorted({c for c in cuts or [] if abs(c) < float("inf")})
    if cuts:
        literal = lambda cs: F.expr(f"array({', '.join(f'{c!r}D' for c in cs)})")  # noqa: E731  (one call to the JVM)
        top, every = literal(cuts[::side]), literal(cuts)
        x = x.withColumn("_ranked_i", F.size(F.filter(top, lambda c: c < F.col("_ranked_m"))))
        x = x.withColumn("_ranked_b", F.coalesce(F.when(F.col("_ranked_i") == 0, 0).otherwise((F.col("_ranked_i") - 1) * side + F.size(F.filter(F.slice(every, (F.col("_ranked_i") - 1) * side + 1, side), lambda c: c < F.col("_ranked_m")))), F.lit(-1)))
        x = x.withColumn("_ranked_b", F.when(F.col("_ranked_m").isNull(), -1).otherwise(F.col("_ranked_b"))).drop("_ranked_i")
    else:
        x = x.withColumn("_ranked_b", F.lit(0))
    totals = x.groupBy(*by, "_ranked_b").agg(F.count("*").alias("_ranked_n"), *[F.sum(c).alias(f"_ranked_t_{k}") for k, c in sums.items()])
    w = Window.partitionBy(*by).orderBy("_ranked_b").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    totals = totals.select(*by, "_ranked_b", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ["_ranked_n", *[f"_ranked_t_{k}" for k in sums]]])
    inner = Window.partitionBy(*by, "_ranked_b").orderBy(*order)
    on = [x["_ranked_b"] == totals["_ranked_b"], *[x[c].eqNullSafe(totals[c]) for c in by]]
    out = x.join(totals.alias("_totals"), on, "left")
    for c in [*by, "_ranked_b"]:
        out = out.drop(totals[c])
    running = inner.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({name: (F.row_number().over(inner) - 1 + F.col("_ranked_n")).cast("long")} | {k: F.sum(c).over(running) + F.col(f"_ranked_t_{k}") for k, c in sums.items()}).drop("_ranked_m", "_ranked_b", "_ranked_n", *[f"_ranked_t_{k}" for k in sums])
