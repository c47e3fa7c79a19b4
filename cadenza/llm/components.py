"""Connected components of a table of links, without ever gathering a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import cut


def _least(links: DataFrame, node: str, other: str) -> DataFrame:
    """The smallest neighbour of every node, written, so that the join with it can split a node that
    holds a large share of the links."""
    return cut(links.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("least")))


def _hang_larger(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's smallest neighbour or the node itself."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, "a", "b").withColumn("least", F.least("node", "least"))
    met = both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("node"))
    return met.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _hang_smaller(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all go to the smallest of them. links have a > b."""
    least = _least(links, "a", "b")
    met = links.join(least, F.col("a") == F.col("node"))
    moved = met.filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select(F.col("node").alias("a"), F.col("least").alias("b"))).distinct()


def _state(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b): root is the smallest node it is linked to.

    Two alternating steps hang nodes on smaller ones until nothing moves; the number of rounds
    grows with the logarithm of the longest path. Links of a node to itself and repeated ones are
    harmless. Each round is written to the shared folder.
    """
    now = cut(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") > F.col("b")).distinct()
    )
    before = None
    while (state := _state(now)) != before:
        before = state
        now = cut(_hang_smaller(_hang_larger(now)))
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())
