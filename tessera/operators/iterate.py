"""Cutting the lineage of iterative plans, and temporary tables, in storage that survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where that is unset and everything runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or "/tmp/checkpoints").rstrip("/")


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared(spark)}/{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept by checkpoint() in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()
