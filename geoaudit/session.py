"""A Spark session with the settings that the plans here are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "geoaudit", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``settings`` (dots as ``__``) go on top."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in settings.items()},
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
