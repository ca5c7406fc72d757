"""Files that queries write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; it goes when the driver ends. Where that is unset (local tests), on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/genospark-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{path.toString()}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: made once, and of a known size, so that a join sends it to all workers only if it is small. A cluster
    without a shared folder makes it anew where it is read."""
    spark = df.sparkSession
    try:
        path = folder(spark, name)
    except ValueError:
        return df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
