"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailsift.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    # The sum wraps by taking remainders, so that it can't overflow.
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**31)))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``links`` has the long columns a and b.  One row per linked node that is not a root: node, root (the smallest of its component).

    Each round joins every link with the least neighbour of one of its ends, picked by an aggregate that combines before the shuffle, so
    a hub with very many links is one row per task.  Rounds grow with the logarithm of the longest chain.  Every round is a written table.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(moved.union(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
