"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes that are their own root are left out.

    edges: columns a, b. Edges without a partner or with equal ends are none; an empty table gives no rows.
    Each round is a few shuffles of the edges, and rounds grow with the logarithm of the longest path.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    before = None
    while True:
        now = materialize(now)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now
        before = state
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))
        large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node").where("root != low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        now = small.unionByName(low.withColumnRenamed("low", "root")).distinct()
