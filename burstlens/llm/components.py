"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlens.llm.places import written


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbourhood."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    larger = both.filter("v > u").join(least, "u")
    return larger.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return others.union(own).distinct()


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)`` but the roots themselves.

    The root is the least node of the component. Alternates between linking nodes to
    the least neighbour from above and from below until nothing changes, which takes
    about as many rounds as the logarithm of a component's size. Every round is written
    to the shared folder, so no lineage grows and a lost executor costs one round. Hot
    nodes are rows of a join, which Spark can split, never one list.
    """
    links = written(links.filter("a <> b").distinct(), "links")
    state = _state(links)
    while True:
        links = written(_small_star(_large_star(links)), "links")
        after = _state(links)
        if after == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = after
