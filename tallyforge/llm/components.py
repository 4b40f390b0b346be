"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Links every larger (or not larger) neighbour of each node to the smallest one. A node with many neighbours
    is aggregated before the shuffle, and its neighbours are not gathered: they join its minimum."""
    n = _both_ways(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = n.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = n.join(least.hint("merge"), "a")
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _settled(e: DataFrame) -> bool:
    """Whether each node is either linked to one smaller node or named by larger ones, not both: all links are stars."""
    roles = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
    seen = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame, among: list[DataFrame] | None = None) -> DataFrame:
    """(node, component) for every node of links (a, b): the component is its smallest node. Links may repeat, run
    either way and name a node with itself; nodes without links are not listed; nulls are ignored. The table
    behind it is added to `among`."""
    now = stored(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(now):
        new = stored(_star(_star(now, True), False), "links")
        dropped(now)
        now = new
    if among is not None:
        among.append(now)
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))
