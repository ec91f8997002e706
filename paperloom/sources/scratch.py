"""Intermediate tables in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the cluster's spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/paperloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """df written as Parquet, in folders of `by` if given, and read again: the lineage ends there."""
    path = scratch_path(df.sparkSession)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch_path()."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
