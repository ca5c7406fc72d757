"""Canonical schemas. Coordinates: reads start 0-based, read ends are exclusive; regions are closed at both ends."""

from __future__ import annotations

from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))

READ = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("qname", T.StringType()), ("flag", T.IntegerType()), ("tid", T.IntegerType()), ("pos", T.IntegerType()), ("mapq", T.IntegerType()),
        ("cigar", T.StringType()), ("mtid", T.IntegerType()), ("mpos", T.IntegerType()), ("isize", T.IntegerType()), ("l_qseq", T.IntegerType()),
        ("seq", T.StringType()), ("qual", T.StringType()), ("rg", T.StringType()), ("nm", T.IntegerType()), ("tags", TAGS))]
)
REGION = T.StructType([T.StructField("id", T.LongType()), T.StructField("chr", T.IntegerType()), T.StructField("pos1", T.IntegerType()), T.StructField("pos2", T.IntegerType()), T.StructField("strand", T.StringType())])
SEQUENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "comment", "seq", "qual", "strand")])
DICTIONARY = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("length", T.LongType())])
