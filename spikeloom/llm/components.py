"""Connected components of a table of links, by repeated joins; nothing of it reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (node, root) for every node that occurs, root being the least node it reaches.

    Each round sends the least neighbour to all larger neighbours (large star), then to all smaller ones (small
    star), until the links form stars. The number of rounds grows with the logarithm of the largest component.
    """
    now = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where(F.col("b") != F.col("m")).select("b", "m").union(down).toDF("a", "b")
        now = cut(small.where(F.col("a") != F.col("b")).distinct())
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
