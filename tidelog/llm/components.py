"""Connected components of a graph of any shape, as joins and aggregates over its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import Scratch, written


def _lowest(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, low): the smallest neighbour of each u; a table of its own, so that a hot u can be split in the join."""
    return scratch.written(links.groupBy("u").agg(F.min("v").alias("low")), "lows")


def _large_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_lowest(both, scratch), "u").filter("v > u")
    return joined.select(F.col("v").alias("u"), F.least("u", "low").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    joined = links.join(_lowest(links, scratch), "u")
    return joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(joined.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()


def _all_stars(links: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and none if it has larger ones."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x"))
    nodes = ends.groupBy("x.node").agg(F.sum("x.up").alias("ups"), F.min("x.up").alias("least"))
    # A node that is a smaller end somewhere has a least of 0.
    return nodes.agg(F.count_if(F.expr("ups > 1 or (ups = 1 and least = 0)"))).first()[0] == 0


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(a, b): component is the smallest node that can be reached.

    Large-star and small-star steps take turns until all links are stars (Kiveris et al., "Connected Components in
    MapReduce and Beyond"): each node that isn't the smallest links to the smallest, and a step would change nothing. Each step is two joins' worth
    of shuffles over the links and never gathers the neighbours of a node. Nodes are whole numbers; null ends and links
    from a node to itself are ignored. Without links the result is empty. The result is a table; those of the steps are
    removed.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.written(pairs, "links")
    while not _all_stars(now):
        large = scratch.written(_large_star(now, scratch), "links")
        now = scratch.written(_small_star(large, scratch), "links")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    result = written(spark, stars, "components")
    scratch.close()
    return result
