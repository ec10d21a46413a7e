"""Session settings and the shared scratch folder used by iterative jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Settings every job here relies on.  The rest (executors, memory, the number
#: of shuffle partitions) belongs to the cluster that runs the job.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the call site of every column expression slows plan building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one that ``spark.checkpoint.dir`` names.

    Where that is unset, as in a local trial, it is the context's checkpoint folder, or else a folder in the warehouse,
    which every task sees as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


class Scratch:
    """Names and writes the intermediate tables of one job run.

    A written table cuts the lineage and survives the loss of any executor;
    reading it back also gives the planner true sizes.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/{job}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.load(name, df.schema)

    def drop(self) -> None:
        """Deletes what the run has written, once nothing reads it any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def load(self, names: str, schema: T.StructType) -> DataFrame:
        """One saved table, or several of the same schema given by a pattern."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{names}")
