"""Connected components of a distributed table of links.

Large-star and small-star steps in turn (Kiveris et al., 2014): every node is
hung on the smallest neighbour that it knows, until the links are stars. Each
step aggregates before it shuffles and joins on a node, which adaptive
execution splits where one node has a large share of the links. The links
never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.session import discard, written


def large_star(links: DataFrame) -> DataFrame:
    """(a, b), a < b: every larger neighbour of a node is hung on the least of the node and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """(a, b), a < b: a node and its smaller neighbours are hung on the least of these."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of links (a, b), a < b."""
    links, before = written(links, "links"), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, old = state, links
        links = written(small_star(large_star(old)), "links")
        discard(old)
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
