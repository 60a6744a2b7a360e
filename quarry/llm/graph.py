"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, result


def _least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and its neighbours. The least is aggregated before the shuffle and joined back, so a node with very many neighbours is never gathered in one task."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each u of the pairs (u, v) has one v and none of these is a u itself."""
    more = pairs.groupBy("u").agg((F.min("v") < F.max("v")).alias("more")).where("more")
    return more.isEmpty() and pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, root for each node of edges (a, b): root is the least node of its component. Links to itself and repeated links do no harm; no links, no rows."""
    if scratch is None:
        with Scratch(edges.sparkSession) as own:
            return result(components(edges, own))
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _least(large)
        now = scratch.keep(down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return scratch.keep(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
