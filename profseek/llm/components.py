"""Connected components of a graph by alternating stars, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.functions.shared import checkpointed


def stored(df: DataFrame, label: str) -> DataFrame:
    """A Parquet copy in the shared folder: it cuts lineage and outlives executors."""
    return checkpointed(df, label)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); component is the smallest node reachable."""
    links = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
                   .distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .filter("u != v").distinct(), "large")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = stored(
            large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(root.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "small")
        # done when a round has changed nothing
        same = small.count() == links.count() and small.join(links, ["u", "v"], "left_anti").isEmpty()
        links = small
        if same:
            break
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
