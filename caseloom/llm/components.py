"""Connected components of an edge table, by contracting stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """Least node of each node's component: columns node and label, for nodes with an edge.

    ``edges`` has columns a and b of one ordered type. Every round joins each node to
    the least of its neighbours (first those above it, then those below), which at
    least halves long paths; the least node of a component ends as the centre of a star.
    Every round is a stored table, so a lost executor repeats at most one round.
    Self-loops, repeated edges and nulls are allowed and change nothing.
    """
    known = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(known.distinct(), "edges")
    mark = _mark(current)
    while True:
        # large star: neighbours above a node move to the least neighbour
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.distinct()
        # small star: a node and its neighbours below move to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        current = stored(small.union(low.select("a", F.col("least").alias("b"))).distinct(), "edges")
        now = _mark(current)
        if now == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        mark = now
