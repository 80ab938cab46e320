"""Connected components of links between documents, by large-star and small-star rounds over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.store import forget, written


HUB, MOST_HUBS = 1000, 1_000_000  # neighbours of a hub, at least; hubs, about


def _stars(links: DataFrame, large: bool, n: int) -> DataFrame:
    """links: n pairs a > b. Each node's neighbours (large: the greater ones; small: itself and the smaller ones) point to its smallest.

    What hubs point to is broadcast, so that no task gets all neighbours of one: with n / MOST_HUBS neighbours or more there are at most 2 * MOST_HUBS of them."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("a", "m"))
    hub = F.col("degree") > max(HUB, n // MOST_HUBS)
    hubs = least.where(hub).select("a", F.col("m").alias("m_hub"))
    known = both.join(F.broadcast(hubs), "a", "left")
    others = known.where("m_hub is null").drop("m_hub").join(least.where(~hub).select("a", "m").hint("merge"), "a")
    pairs = others.select("a", "b", "m").union(known.where("m_hub is not null").select("a", "b", F.col("m_hub").alias("m")))
    if large:
        out = pairs.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b of any order. Returns node, component (its smallest node) for all nodes of links but the smallest of each component."""
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = (now.count(), None)
    while True:
        after = written(_stars(_stars(now, True, mark[0]), False, mark[0]), "links")
        forget(now)
        now = after
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = new
