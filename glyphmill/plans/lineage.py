"""Durable cuts of the lineage: every executor can be lost without losing the rows behind a cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that is unset and the master is local, a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="glyphmill-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, *partition_by: str) -> str:
    """Path of `df` written as Parquet into the shared folder; it is deleted when the application ends."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
