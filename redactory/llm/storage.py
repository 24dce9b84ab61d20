"""Intermediate tables in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where
that setting is absent (a laptop, a test) does a temporary folder stand in.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch: long texts then need little memory in a worker.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI or path that Spark's writers accept."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="redactory-"))
            held = spark.sparkContext.getCheckpointDir()
        named = held
    return named.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's default of 10,000 rows an Arrow batch, unless a user chose a number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Tables of one job below the shared folder.

    They last as long as the application, whose results read them; Hadoop deletes the folder when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again: its lineage ends here and survives lost executors."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of the job."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
