"""The folder that driver and executors share, and what lies in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; of its own only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='shared_')}"


def written(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` whose writing ended; none if there is no such folder."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if fs.exists(jvm.Path(s.getPath(), "_SUCCESS")))


def table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: worked out once, whatever executors are lost later."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
