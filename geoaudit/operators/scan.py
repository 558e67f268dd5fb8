"""Scoring regions: the likelihood-ratio scan and the variance-of-rates baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import likelihood_ratio, rate, rounded


def scored(regions: DataFrame, total: int, positive: int, direction: str = "both") -> DataFrame:
    """Regions with ``rho`` (null if empty) and ``sul``; both rounded to six digits."""
    value = likelihood_ratio(F.col("n"), F.col("p"), F.lit(total).cast("long"), F.lit(positive).cast("long"), direction)
    return regions.withColumn("rho", F.round(rate(F.col("p"), F.col("n")), 6)).withColumn("sul", rounded(value))


def best_region(scores: DataFrame, *keys: str) -> DataFrame:
    """The region of the largest score, the first of equals; no row without regions."""
    top = F.max_by(F.struct(*(c for c in scores.columns if c not in keys)), F.struct("sul", -F.col("region_id"))).alias("best")
    return scores.groupBy(*keys).agg(top).where("best is not null").select(*keys, "best.*")


def deviations(regions: DataFrame, *keys: str) -> DataFrame:
    """Regions with ``mv_score``, the squared distance of their rate from the mean rate; null if empty."""
    rated = regions.withColumn("r", F.round(rate(F.col("p"), F.col("n")), 6))
    mean = F.avg("r").over(Window.partitionBy(*keys))
    return rated.withColumn("mv_score", rounded((F.col("r") - mean) * (F.col("r") - mean), 8)).withColumnRenamed("r", "rho")


def variance_summary(regions: DataFrame, *keys: str) -> DataFrame:
    """Unweighted population variance of the rates, mean and largest deviation, and its region.

    Empty regions have no rate. With no rate at all everything is 0 and the first region is the best.
    """
    scores = deviations(regions, *keys)
    grouped = scores.groupBy(*keys).agg(
        F.count("*").alias("n_regions"),
        F.coalesce(rounded(F.var_pop("rho")), F.lit(0.0)).alias("meanvar"),
        F.coalesce(rounded(F.avg("mv_score")), F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.max("mv_score"), F.lit(0.0)).alias("max_score"),
        F.max_by(F.struct("region_id", "n", "p", "rho"), F.struct(F.coalesce("mv_score", F.lit(-1.0)), -F.col("region_id"))).alias("best"),
    )
    return grouped.select(*keys, "n_regions", "meanvar", "mean_score", "max_score", F.col("best.region_id").alias("best_region_id"), F.coalesce("best.n", F.lit(0)).alias("best_n"), F.coalesce("best.p", F.lit(0)).alias("best_p"), F.col("best.rho").alias("best_rho"))
