"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import fresh_folder


def _stored(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    spark = frame.sparkSession
    folder = fresh_folder(spark, "links")
    frame.write.parquet(folder)
    return spark.read.parquet(folder)


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    larger = both.filter("b > a").join(least, "a")
    return larger.select(F.col("low").alias("a"), "b").filter("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. ``links`` have a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("low"))
    moved = links.join(least, "b")
    kept = least.select(F.col("low").alias("a"), "b")
    others = moved.filter("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return kept.union(others).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) of all linked nodes; the component is its smallest node.

    Links are pairs of integers in any order, repeats and self-links allowed; null ends link nothing.
    The steps end when all links point at the smallest node of their component: then a step changes
    neither the number of links nor the sum of their fingerprints. An empty table gives none.
    """
    links = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).alias("_x"), F.col(b).alias("_y"))
    links = links.filter("_x IS NOT NULL AND _y IS NOT NULL AND a < b").select("a", "b").distinct()
    state, links = None, _stored(links)
    while True:
        mark = F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1))
        found = links.agg(F.count(F.lit(1)), mark).first()
        if tuple(found) == state or not found[0]:
            break
        state = tuple(found)
        links = _stored(_small_star(_large_star(links)))
    stars = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
