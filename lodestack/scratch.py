"""Shared storage for intermediate tables.

Everything an operator must keep between jobs goes to the folder that the
session names in ``spark.checkpoint.dir``: it is visible to all executors, so a
lost executor costs a re-read and not the data.  Only where that setting is
absent and Spark runs in one process (tests, a laptop) a folder of our own is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Spark removes a query's shuffle files as soon as the query has ended, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="lodestack-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed now and cut from its lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """A folder of Parquet tables that goes when the ``with`` block ends.

    What leaves the block must not read from it any more: return
    ``checkpointed(...)`` frames or frames over the inputs.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        try:
            before = self.spark.conf.get(CLEANUP)
        except PySparkException:  # a Spark without that setting
            before = None
        if before is not None:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is not None:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.drop()
