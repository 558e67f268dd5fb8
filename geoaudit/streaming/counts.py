"""Grid counts over a stream of points: the batch plans' cells, kept up to date by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.regions import cell_ids
from ..operators.scan import scored
from ..sources.points import Profile


def stream_cells(points: DataFrame, extent: Profile, lon_n: int, lat_n: int) -> DataFrame:
    """``region_id, n, p`` of a streaming (or batch) point table over a fixed extent; points outside it are in
    no cell. A streaming aggregate with one state row for each cell: use output mode complete or update."""
    ids = cell_ids(extent, F.lit(lon_n), F.lit(lat_n))
    members = points.select(F.explode(ids).alias("region_id"), F.col("outcome").cast("long").alias("outcome"))
    return members.groupBy("region_id").agg(F.count("*").alias("n"), F.sum("outcome").alias("p"))


def scored_batches(counts: DataFrame, extent: Profile, sink):
    """Start a query that hands ``sink(frame, batch)`` the cells scored after each micro-batch, against the
    totals of all cells."""

    def score(batch: DataFrame, number: int) -> None:
        total = batch.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("p"), F.lit(0)).alias("p")).first()
        sink(scored(batch, total["n"], total["p"]), number)

    return counts.writeStream.outputMode("complete").foreachBatch(score).start()
