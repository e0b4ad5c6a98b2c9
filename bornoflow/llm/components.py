"""Connected components of a graph whose edges may be of any number: alternating large and small stars, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b; of one type, not null): root is the smallest node of the node's component.

    Each round first links every node's larger neighbours to its smallest neighbour, then its smaller ones; both keep
    the components as they are. The number of edges never grows, and rounds grow as the logarithm of the longest path.
    A round's edges are checkpointed, so lineage stays short and lost executors cost one round.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = small.where("u <> v").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
