"""Connected components as iterated joins (large and small stars: Kiveris and others 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import Rounds


def _least(edges: DataFrame) -> DataFrame:
    """``u, least`` of each node's neighbours and itself."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are tied to the least of all its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return tied.unionByName(least.withColumnRenamed("least", "v")).where("u <> v").distinct()


def components(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """``node, component``: each node of ``edges`` (``u, v``) and the least node that can be reached from it.

    Each round writes its edges; it ends when a round leaves them as they were, all of them from a node to the
    least one. Nodes without edges to others are not in the result.
    """
    known = rounds.kept(edges.where("u <> v").select("u", "v").distinct())
    before = None
    while True:
        known = rounds.kept(_small(_large(known)))
        now = tuple(known.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    own = known.select("v").distinct()
    return known.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own.select(F.col("v").alias("node"), F.col("v").alias("component")))
