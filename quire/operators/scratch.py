"""Cutting the lineage of loops through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in a checkpoint below spark.checkpoint.dir. A local session without one gets a folder of its own;
    on a cluster its absence is an error."""
    root(df.sparkSession)
    return df.checkpoint()


def root(spark: SparkSession) -> str:
    """The shared folder of the session."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{root(spark)}/quire/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from files below the shared folder: their size is known, so that Spark broadcasts few rows."""
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
