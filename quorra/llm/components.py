"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorra.llm.common import saved


#: Tables of up to so many edges (a few MB) are finished in one task; larger ones in rounds, with the same result.
AT_ONCE = 100_000


def _solve(edges: pd.DataFrame) -> pd.DataFrame:
    node, ends = np.unique(edges[["u", "v"]].to_numpy().ravel(), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root = np.arange(len(node))
    while True:
        x, y = root[a], root[b]
        if np.array_equal(x, y):
            return pd.DataFrame({"node": node, "root": node[root]})
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up


def connected_components(edges: DataFrame, name: str = "components", files: int | None = None) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node of its component.

    Nodes are longs. Self-loops and repeated edges are allowed, edges with a null end are dropped, an empty
    table gives an empty table. Every round re-hangs the neighbours of a node on its smallest neighbour; rounds
    grow with the logarithm of a component's size, never with its diameter, and each is a written table, of at most
    ``files`` files if given.
    """
    edge = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edge = saved(edge, name, files=files)
    if edge.count() <= AT_ONCE:
        return edge.withColumn("slot", F.lit(0)).groupBy("slot").applyInPandas(_solve, "node long, root long")
    mark = None
    while True:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edge = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name, files=files)
        now = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == now:
            break
        mark = now
    return edge.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edge.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
