"""Structured Streaming over read and event tables: an extension. Rules are stateless Columns, so they apply to a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genospark.functions import flags as A
from genospark.operators.stats import group_key
from genospark.plans.rules import FilterCollection


def parquet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def filtered(stream: DataFrame, rules: FilterCollection) -> DataFrame:
    return stream.where(rules.column())


def read_group_counts(stream: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per read group and window of event time; state older than the watermark goes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), group_key().alias("read_group")).agg(
        F.count("*").alias("reads"), F.count_if(A.duplicate()).alias("duplicate"), F.count_if(~A.mapped()).alias("unmapped")
    )


def event_counts(stream: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count("*").alias("n"))
