"""One-hot encoding of mixed rows: a bit for each value of a categorical column, a dense vector of the continuous ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def observed(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value) pairs that occur, in one scan; nulls don't occur."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.feature", "p.value").where("value IS NOT NULL").distinct()


@dataclass
class OneHot:
    """Columns of strings and those named in `categorical` get bits; other columns of numbers and booleans are continuous.

    `bits` is (feature, value, bit), numbered in the order of feature and value."""

    categorical: list[str]
    continuous: list[str]
    bits: DataFrame

    @staticmethod
    def fit(df: DataFrame, columns: list[str], categorical: tuple[str, ...] = ()) -> "OneHot":
        kinds = dict(df.dtypes)
        missing = [c for c in columns if c not in kinds]
        if missing:
            raise ValueError(f"no column {missing[0]}")
        cat = [c for c in columns if kinds[c] == "string" or c in categorical]
        bits = observed(df, cat) if cat else df.sparkSession.createDataFrame([], "feature string, value string")
        # a vocabulary of categories is small against its table; it is numbered by feature and then shifted
        within = F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1
        sizes = bits.groupBy("feature").count().select("feature", (F.sum("count").over(Window.orderBy("feature")) - F.col("count")).alias("before"))
        numbered = bits.withColumn("r", within).join(F.broadcast(sizes), "feature").select("feature", "value", (F.col("before") + F.col("r")).cast("int").alias("bit"))
        return OneHot(cat, [c for c in columns if c not in cat], numbered)

    def features(self) -> tuple[int, int]:
        """Number of bits and of dense columns."""
        return self.bits.count(), len(self.continuous)

    def encode(self, df: DataFrame, row: str) -> DataFrame:
        """(row, col, val): the bits of each row; values never observed have none."""
        if not self.categorical:
            return df.select(F.col(row), F.lit(None).cast("int").alias("col"), F.lit(None).cast("double").alias("val")).where("false")
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in self.categorical]))
        x = df.select(F.col(row), pairs.alias("p")).select(row, "p.feature", "p.value")
        return x.join(self.bits, ["feature", "value"]).select(row, F.col("bit").alias("col"), F.lit(1.0).alias("val"))

    def dense(self, df: DataFrame, row: str) -> DataFrame:
        """(row, code): the continuous columns as doubles, booleans as 0 and 1, missing as 0."""
        kinds = dict(df.dtypes)
        cells = [F.coalesce((F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)).cast("double"), F.lit(0.0)) for c in self.continuous]
        return df.select(row, F.array(*cells).alias("code"))

    def restrict(self, kept: DataFrame) -> "OneHot":
        """Only the bits in `kept` (bit), numbered anew without gaps in their order."""
        new = F.row_number().over(Window.orderBy("bit")) - 1  # the vocabulary, not the data
        return OneHot(self.categorical, self.continuous, self.bits.join(kept.select("bit").distinct(), "bit", "left_semi").withColumn("bit", new.cast("int")))
