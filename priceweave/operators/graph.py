"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Links that one task takes: small graphs are kept in few partitions, as each round has several exchanges.
TASK_LINKS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of each node that an edge of a, b (same type, not null) touches.

    Each round links every node to its smallest neighbour, first from the larger ones, then from the smaller ones, and
    ends when that changes nothing: logarithmically many rounds. Groups are only reduced to their minimum, with partial
    minima before the shuffle, so a hub costs no task more than its share."""
    links = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, _state(links)
    while now != before and now[0]:
        tasks = -(-now[0] // TASK_LINKS)
        links = links.coalesce(tasks)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        links = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks))
        before, now = now, _state(links)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _state(links: DataFrame) -> tuple:
    """The number of links and a sum of their hashes: equal states are equal links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
