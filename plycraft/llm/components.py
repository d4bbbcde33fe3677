"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them (u > v in edges)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def stars(edges: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """(u, v) for every node u that is not the least of its component, v being the least.

    ``edges``: pairs (u, v) of ids. Minima are aggregated before the shuffle and joined
    back, so a node with very many neighbours is a skewed join, which AQE splits, and never
    a collected list. Each round is written to ``scratch`` and the round before it dropped;
    the number of rounds grows with the logarithm of a component's size."""
    now = scratch.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    last = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == last or not mark[0]:
            return now
        last = tuple(mark)
        now = scratch.table(_small_star(_large_star(now).distinct()).distinct(), name)
        scratch.drop_older(name)
