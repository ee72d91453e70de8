"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import Work

#: Up to so many edges (16 bytes each) the driver finds the components; beyond, alternating star contractions on the cluster do. Same result.
DRIVER_EDGES = 2_000_000


def components(edges: DataFrame, work: Work, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(id, component) of every node of edges (a, b), where a component is called by its least node. Loops and repeats don't matter."""
    e = work.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    if e.count() <= driver_edges:
        return _on_driver(e)
    before = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
        large = both.withColumn("m", least).where("b > a").select(F.col("m").alias("a"), "b").distinct()
        up = large.select(F.col("b").alias("u"), F.col("a").alias("v")).withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = up.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("u").alias("b")), F.struct(F.col("m").alias("a"), F.col("v").alias("b")))).alias("x")).select("x.a", "x.b").where("a < b").distinct()
        e = work.table(small)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def _on_driver(e: DataFrame) -> DataFrame:
    import pandas as pd

    pairs = e.toPandas()
    ids, at = np.unique(pairs[["a", "b"]].to_numpy(np.int64).ravel(), return_inverse=True)
    a, b = at.reshape(-1, 2).T if len(ids) else (np.zeros(0, int), np.zeros(0, int))
    root = np.arange(ids.size)
    while a.size:
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return e.sparkSession.createDataFrame(pd.DataFrame({"id": ids, "component": ids[root]}).astype("int64"), "id long, component long")
