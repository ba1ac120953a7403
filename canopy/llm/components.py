"""Connected components of a link table, by alternating star steps.

Each step replaces links by links to the smallest neighbour. The smallest neighbour is a grouped minimum joined
back, so a node with very many links is combined before the shuffle and split as a skewed join key; no task holds
the neighbours of a node. Every round is cut with a reliable checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    return (both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)``: for each linked node the smallest node that it reaches (itself left out)."""
    ordered = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = cut_lineage(ordered.distinct())
    state = None
    while True:
        seen = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == tuple(seen):
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(seen)
        links = cut_lineage(_small_star(_large_star(links)))
