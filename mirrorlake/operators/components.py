"""Connected components of an edge list, with no driver-side graph and no group in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorlake.sources.shared import drop_stash, stash


def components(edges: DataFrame, name="components") -> DataFrame:
    """edges (a, b) -> (node, root): root is the least node that a node reaches. Nodes without an edge to
    another are not listed.

    Alternating large-star and small-star rounds until only stars are left; the number of rounds
    grows with the logarithm of the longest chain. Hubs meet in sort-merge joins, whose hot keys adaptive
    execution splits, and the aggregates combine before they shuffle."""
    now = stash(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v != m").select(F.col("v"), F.col("m"))).distinct()
        after = stash(small, name)
        drop_stash(now)
        now = after
        # stars at last: no node has two parents and no parent has one
        again = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").limit(1)
        if again.isEmpty() and now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
