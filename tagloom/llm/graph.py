"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.runtime import pin


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b of one orderable type); root: the smallest node reachable.

    Large-star links the larger neighbours of a node with its smallest neighbour,
    small-star does so for the smaller ones; repeated in turn they leave a star per
    component after about the logarithm of its size. Every round is pinned.
    """
    now = pin(edges.select("a", "b").filter("a <> b").distinct())
    last = None
    while True:
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = now.select(F.explode(ways).alias("e")).select("e.*")
        low = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
        # A row for each edge; equal ones meet in the distinct below.
        large = both.withColumn("m", low).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = F.min("b").over(Window.partitionBy("a"))
        small = large.withColumn("m", least)
        links = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = pin(links.select("e.*").filter("a <> b").distinct())
        check = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if check == last:
            break
        last = check
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
