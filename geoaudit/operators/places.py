"""Places of rows in an order, without a partition that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import Rounds


def with_places(rows: DataFrame, order: list[Column], rounds: Rounds, *groups: str) -> DataFrame:
    """``rows`` with ``place``, from 0 in the given order, within each of the groups (without nulls) if there are any.

    One range sort, in which a large group spreads over as many partitions as it needs. A row's place follows from
    its number in the sorted table and from where its group begins in each partition, a row for each.
    """
    keys = [*(F.asc(g) for g in groups), *order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = rounds.kept(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = rounds.kept(runs.select(*groups, "_part", (before - F.col("_first")).alias("_shift")))
    return placed.join(shifts, [*groups, "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
