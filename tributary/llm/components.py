"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.text import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large stars (each node ties its larger neighbours to its smallest) and small stars (its smaller
    neighbours), until nothing changes: a logarithmic number of rounds. Every round's edges go through the checkpoint folder. A
    hub's edges are joined to its minimum, which adaptive execution can split; minima are combined before they are shuffled.
    """
    current = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        current = cut(small.distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
