"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import cut_lineage


def _settled(links: DataFrame) -> bool:
    """Whether every id has one link at most, and none to an id that has one itself."""
    below = links.select(F.col("a").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    above = links.select(F.col("b").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    ends = below.union(above).groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.filter("below > 1 OR (below > 0 AND above > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id in a link (a, b) the smallest id it can reach.

    Large-star and small-star steps in turn: each id hands its larger, then its
    smaller neighbours to the smallest one, until all links are stars. Minima are
    combined before the shuffle, so a busy id is no bottleneck; links to oneself
    and repeated links change nothing.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut_lineage(links)
    while not _settled(links):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").filter("b > a AND b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        links = cut_lineage(small.union(least).distinct())
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.union(links.select("b", "b").distinct())
