"""Tables that an operator writes between its steps, in the folder that the whole cluster shares.

A written table is cut off from its lineage: when an executor is lost, later steps read it again
instead of computing it again. The folder is ``spark.checkpoint.dir``; only where that is unset and all
runs on this machine (tests, notebooks) a temporary one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a folder of our own where none is set and Spark runs locally."""
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="geoaudit-")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


class Scratch:
    """A folder of tables that belong to one run of one operator, or of its caller, who can ``drop`` them.

    What is left goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/geoaudit/{label}-{uuid.uuid4().hex}"
        self.tables = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table as read back."""
        self.tables += 1
        path = f"{self.path}/{self.tables}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        if self.tables == 1:
            self._fs().deleteOnExit(self._path(self.path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete the given tables, or all of them."""
        if not tables:
            self._fs().delete(self._path(self.path), True)
        for table in tables:
            for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                self._fs().delete(self._path(folder), True)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
