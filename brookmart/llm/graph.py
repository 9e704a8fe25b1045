"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, saved


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node (large: the greater ones; else the smaller ones and itself) with the least of them."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("x"), F.col("a").alias("y"), "m")
        out = out.select(F.explode(F.array("x", "y")).alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node that it reaches) of every node in links (a, b); nodes without links don't appear.

    Links may repeat, in either direction, and join a node with itself; those with a null end are left out. Every round
    is grouped by node with partial minima, so a node with very many links is no bottleneck; rounds are written to the
    shared folder. Rounds grow with the logarithm of the longest path.
    """
    now, before = links.select("a", "b").filter("a <> b").distinct(), None
    while True:
        now = saved(_star(_star(now, True), False), "links")
        if before is not None:
            discard(before)
        before = now
        # Done when every node has one link, and none leads to a node that has one itself.
        many = now.groupBy("a").count().filter("count > 1").select("a")
        onward = now.select(F.col("b").alias("a")).distinct().join(now.select("a"), "a", "left_semi")
        if many.unionByName(onward).isEmpty():
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
