"""The reference dictionary (id, name, length): a table that Spark broadcasts in lookups where its size allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genospark.functions import region as R
from genospark.schema import DICTIONARY


def from_pairs(spark: SparkSession, entries: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame([(i, n, int(length)) for i, (n, length) in enumerate(entries)], DICTIONARY)


def from_text(spark: SparkSession, header: str) -> DataFrame:
    """The @SQ lines of header text, in order."""
    entries = []
    for line in header.splitlines():
        if line.startswith("@SQ"):
            fields = dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f)
            entries.append((fields["SN"], int(fields["LN"])))
    return from_pairs(spark, entries)


def header_lines(dictionary: DataFrame) -> DataFrame:
    """@SQ lines, by id."""
    line = F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("length").cast("string"))
    return dictionary.select("id", line.alias("line"))


def header_text(dictionary: DataFrame) -> str:
    return "".join(r["line"] + "\n" for r in header_lines(dictionary).orderBy("id").collect())


def with_id(df: DataFrame, dictionary: DataFrame, name: str, to: str, retry_prefix: bool = False) -> DataFrame:
    """``df`` with the id of ``name``, -1 if unknown. ``retry_prefix``: plain chromosome names are tried again as chr + name."""
    ids = dictionary.select(F.col("name").alias("__name"), F.col("id").alias(to))
    out = df.join(ids, F.col(name) == F.col("__name"), "left").drop("__name")
    if retry_prefix:
        again = dictionary.select(F.col("name").alias("__name"), F.col("id").alias("__again"))
        tried = F.when(F.col(to).isNull() & F.col(name).rlike("^[0-9XY]+$"), F.concat(F.lit("chr"), F.col(name)))
        out = out.join(again, tried == F.col("__name"), "left").withColumn(to, F.coalesce(to, "__again")).drop("__name", "__again")
    return out.withColumn(to, F.coalesce(F.col(to), F.lit(-1)))


def with_name(df: DataFrame, dictionary: DataFrame, chrom: str = "chr", to: str = "name", fallback: Column | None = None) -> DataFrame:
    """``df`` with the name of each id: empty below 0, the dictionary's, else the number as text (or ``fallback``)."""
    names = dictionary.select(F.col("id").alias("__id"), F.col("name").alias("__n"))
    other = F.col(chrom).cast("string") if fallback is None else fallback
    out = df.join(names, F.col(chrom) == F.col("__id"), "left")
    return out.withColumn(to, F.when(F.col(chrom) < 0, "").otherwise(F.coalesce("__n", other))).drop("__id", "__n")


def with_region_name(df: DataFrame, dictionary: DataFrame, to: str = "name") -> DataFrame:
    names = dictionary.select(F.col("id").alias("__id"), F.col("name").alias("__n"))
    return df.join(names, F.col("chr") == F.col("__id"), "left").withColumn(to, F.coalesce("__n", R.default_name())).drop("__id", "__n")


def length_of(dictionary: DataFrame, key: int | str) -> int:
    """Length by id or name; -1 if unknown."""
    found = dictionary.where(F.col("id" if isinstance(key, int) else "name") == key).select("length").first()
    return -1 if found is None else found[0]


def name_of(dictionary: DataFrame, key: int) -> str:
    found = dictionary.where(F.col("id") == key).select("name").first()
    if found is None:
        raise KeyError(f"no reference sequence {key}")
    return found[0]


def id_of(dictionary: DataFrame, name: str) -> int:
    found = dictionary.where(F.col("name") == name).select("id").first()
    return -1 if found is None else found[0]
