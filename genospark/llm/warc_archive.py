"""A content-addressed WARC archive.

Two tables make the archive. ``payloads`` holds the bytes of each distinct payload once, under its SHA-256, with the SHA-1 that record
headers name; length and SHA-1 are computed anew when read. ``heads`` holds for each record its exact leading bytes: the WARC header
and the HTTP header. A record is its head, for a response followed by the payload, then two line ends; a join on the SHA-256 restores it.
Payloads and the heads of responses are bucketed by SHA-256, so the bytes of payloads are shuffled once, when they are grouped, and never
to be read. Heads of revisits are dealt out, as any number of them may name one payload.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genospark.llm.storage import Scratch

_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: four groups of 40 bits, each eight letters."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def _lines(*lines: Column) -> Column:
    return F.concat(*[F.concat(line, F.lit(_END)) for line in lines], F.lit(_END))


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")


def _bucketed(df: DataFrame, scratch: Scratch, name: str, key: str) -> DataFrame:
    """``df`` as a table whose buckets, by ``key``, are as many as the session's shuffle partitions."""
    spark = scratch.spark
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{scratch.root.rpartition('/')[2]}_{name}".replace("-", "_")
    writer = df.write.format("parquet").option("path", f"{scratch.root}/{name}").option("compression", "zstd")
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def write_archive(pages: DataFrame, scratch: Scratch, date: str = "1970-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """One WARC record per row of ``pages`` (page_id, url, html), as the tables (heads, payloads).

    Null html is the empty payload, null url an empty target; characters that would break a header line become %20. Of records with
    equal payloads, empty ones too, that with the largest page_id is a response and the others revisit it; a null page_id counts as
    smallest. Repeated rows of the largest page_id are all responses. Payloads that share a SHA-1 but not a SHA-256 are stored apart.
    """
    record = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8").alias("payload"))
    record = record.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    # equal payloads meet in an aggregate that begins before the shuffle, so one that many pages share is no hot key
    stored = record.groupBy("sha256").agg(F.max("page_id").alias("response_id"), F.first("payload").alias("payload"))
    payloads = _bucketed(stored.select("sha256", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("length"), "response_id", "payload"), scratch, "payloads", "sha256")
    plain = scratch.spark.read.schema(payloads.schema).parquet(f"{scratch.root}/payloads")  # without buckets, so that a hot key's rows can be split in the join
    keys = plain.select(F.col("sha256").alias("key"), "response_id", "digest", "length")
    joined = record.select("page_id", "url", "sha256").join(keys, F.col("sha256") == F.col("key"))
    is_response = F.col("page_id").eqNullSafe(F.col("response_id"))
    uri = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("length").cast("string")))
    common = [F.concat(F.lit("WARC-Record-ID: "), uri("page_id")), F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.lit("Content-Type: application/http; msgtype=response")]
    size = lambda body: F.concat(F.lit("Content-Length: "), (F.octet_length("http") + body).cast("string"))
    response = _lines(F.lit("WARC/1.0"), F.lit("WARC-Type: response"), *common, size(F.col("length")))
    revisit = _lines(F.lit("WARC/1.0"), F.lit("WARC-Type: revisit"), *common, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), F.concat(F.lit("WARC-Refers-To: "), uri("response_id")), size(F.lit(0)))
    head = F.encode(F.concat(F.when(is_response, response).otherwise(revisit), F.col("http")), "UTF-8")
    heads = joined.withColumn("http", http).select("sha256", is_response.alias("response"), head.alias("head"))
    place = F.when(F.col("response"), F.col("sha256")).otherwise(F.unhex(F.sha2("head", 256)))
    buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    return _bucketed(heads.withColumn("place", place).repartition(buckets, "place"), scratch, "heads", "place"), payloads


def parsed_heads(heads: DataFrame) -> DataFrame:
    """The fields of each record's head, from its bytes: page_id, digest, record_type, refers_to, next to the columns of ``heads``."""
    text = F.decode("head", "UTF-8")
    field = lambda pattern: F.regexp_extract(text, rf"(?md)^{pattern}\r$", 1)
    number = lambda pattern: F.when(field(pattern) != "", field(pattern).cast("long"))
    return heads.select(
        number("WARC-Record-ID: <urn:x-page:(-?[0-9]*)>").alias("page_id"),
        field("WARC-Payload-Digest: sha1:([A-Z2-7]{32})").alias("digest"),
        field("WARC-Type: ([a-z]+)").alias("record_type"),
        number("WARC-Refers-To: <urn:x-page:(-?[0-9]*)>").alias("refers_to"),
        *heads.columns,
    )


def read_archive(heads: DataFrame, payloads: DataFrame, contents: bool = False) -> DataFrame:
    """The records of an archive: page_id, payload_bytes, payload_digest, record_type, refers_to; with ``contents`` also payload and record (bytes).

    Every record is rebuilt from its head and, for a response, the stored payload; digest and length are those of the bytes behind the
    head. A stored payload that no longer has the digest that the head names, or one that is gone, is an error. A revisit's payload is
    that of the SHA-256 it is filed under.
    """
    stored = payloads.select(F.col("sha256").alias("key"), "payload")
    responses = heads.where("response").join(stored.hint("merge"), F.col("place") == F.col("key"), "left")
    # the bytes that a reader has: the head, the payload, two line ends
    responses = responses.withColumn("record", F.concat("head", "payload", F.lit(b"\r\n\r\n")))
    body = F.expr("substring(record, octet_length(head) + 1, octet_length(record) - octet_length(head) - 4)")
    facts = [base32_sha1(F.col("payload")).alias("found"), F.octet_length("payload").cast("long").alias("payload_bytes")]
    read = responses.select("head", "record", body.alias("payload")).select("*", *facts)
    named = stored.select("key", *facts, *(["payload"] if contents else []))
    revisits = heads.where("not response").join(named, F.col("sha256") == F.col("key"), "left")
    revisits = revisits.select("head", F.concat("head", F.lit(b"\r\n\r\n")).alias("record"), *([F.col("payload")] if contents else [F.lit(None).cast("binary").alias("payload")]), "found", "payload_bytes")
    good = F.when(F.col("found") == F.col("digest"), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("payload missing or changed: "), F.col("digest"))))
    out = parsed_heads(read.unionByName(revisits)).select("page_id", "payload_bytes", good.alias("payload_digest"), "record_type", "refers_to", "payload", "record")
    return out if contents else out.drop("payload", "record")


def export_warc(records: DataFrame, path: str) -> None:
    """Write restored records as gzip-compressed WARC files, through Spark's writer (any store). Records are UTF-8 throughout."""
    text = F.decode(F.expr("substring(record, 1, length(record) - 4)"), "UTF-8")
    records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, cut by their Content-Length: head and payload bytes. A file is read by one task."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)
                at, rows = 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    length = next(int(x.split(b":")[1]) for x in data[at:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    body = end + data[end : end + length].index(b"\r\n\r\n") + 4
                    rows.append((data[at:body], data[body : end + length]))
                    at = end + length + 4
                yield pd.DataFrame(rows, columns=["head", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(cut, "head binary, payload binary")
