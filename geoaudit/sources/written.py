"""Tables that an iterative operator writes between its rounds, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


class Rounds:
    """A folder for the tables of one run: each cuts off what it was computed from, so that plans stay short, a lost
    executor costs reading a table again, and sizes are known when the next round is planned.

    The folder is in ``spark.checkpoint.dir``; only where that is unset and Spark runs on this machine alone, a
    temporary one is made. It is deleted when the session ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        root = spark.conf.get(SETTING, None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="geoaudit-rounds-")
            spark.conf.set(SETTING, root)
        self.spark, self.folder, self.n = spark, f"{root.rstrip('/')}/geoaudit/{label}-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        """A path that nothing is at."""
        self.n += 1
        if self.n == 1:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            files.mkdirs(folder)
            files.deleteOnExit(folder)
        return f"{self.folder}/{self.n}"

    def kept(self, rows: DataFrame) -> DataFrame:
        """``rows`` as written and read again."""
        path = self.path()
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)
