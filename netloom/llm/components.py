"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.stages import settle


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node that is not a root itself.

    ``edges`` has two columns ``a, b`` of one orderable type.  Each round hangs every
    neighbour of a node onto the smallest one: first the larger neighbours, then the smaller
    ones.  The number of rounds grows with the logarithm of the longest path; each round is
    written to the shared folder.  Minima are combined on the map side, and a node with very
    many neighbours sits on the large side of a plain join, which adaptive execution splits.
    """
    a, b = F.col("a"), F.col("b")
    now = settle(edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "star")
    before, state = None, _state(now)
    while state != before:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy(a.alias("hub")).agg(F.min("b").alias("low"))
        low = low.select("hub", F.least("hub", "low").alias("low"))
        larger = both.where("b > a").join(low, F.col("a") == F.col("hub"))
        now = settle(larger.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "star")
        low = now.groupBy(a.alias("hub")).agg(F.min("b").alias("low"))
        smaller = now.join(low, F.col("a") == F.col("hub")).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = settle(smaller.unionByName(low.select(F.col("hub").alias("a"), F.col("low").alias("b"))).distinct(), "star")
        before, state = state, _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
