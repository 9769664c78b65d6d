"""Connected components of a link table by alternating star contractions, in Spark rounds over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutwise.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """node, root (its component's least node) for every node in `links` (a, b: long).

    Each round every node sends its larger neighbours, then its smaller ones, to its least neighbour. Stars only shrink,
    every group is a minimum, and the loop ends when a round changes nothing: O(log squared) rounds.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: u's larger neighbours go to the least of u and all its neighbours.
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its smaller neighbours go to the least of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = stored(small)
        # Done when every node has one smaller neighbour and no such neighbour has one itself.
        nested = after.select(F.col("v").alias("u")).distinct().join(after, "u", "left_semi").limit(1).count()
        split = 0 if nested else after.groupBy("u").count().filter("count > 1").limit(1).count()
        discard(edges)
        edges = after
        if not nested and not split:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
