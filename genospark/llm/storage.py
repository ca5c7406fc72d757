"""Tables that cut lineage: written once to the folder all executors share, and read again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (local tests) a new one on this machine."""
    found = spark.conf.get(_SETTING, None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"genospark-{os.getuid()}-{os.getpid()}")
    spark.conf.set(_SETTING, own)
    return own


#: Rows and bytes of a batch that goes to a Python worker; the first is Spark's own default, which very long texts would overfill.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "64m")}


def bound_batches(spark: SparkSession) -> None:
    """Keep batches of long texts small, unless the session has settings of its own."""
    for key, (default, ours) in _BATCHES.items():
        if default is None or spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


class Scratch:
    """Parquet tables of one operator run. ``drop`` removes a table that no later result reads; all others go when the driver ends, as a
    result that is still to be computed may read them."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path = self._path("")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as the table ``name`` and return it as read back; an executor lost later costs a re-read only."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra or clashing columns of the caller never meet ours."""
    return df.select(*[df[c] for c in columns])
