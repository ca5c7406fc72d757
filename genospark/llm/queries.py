"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from genospark.llm import bpe_codec, decontamination, embedding_dedup, language_id, line_dedup, setsketch_dedup, sharding, suffix_dedup, token_counts, warc_archive
from genospark.llm.storage import Scratch, bound_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary(token_counts.VOCABULARY)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.encode_digests(docs, vocabulary(bpe_codec.VOCABULARY)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.with_size(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    placed = sharding.shard_by_bytes(docs, 40)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn_from_documents(docs)
    marked = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.predict(marked, model).select("doc_id", "held_out", "lang_pred", "score")


def op4_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, payloads = warc_archive.write_archive(table(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    return warc_archive.read_archive(heads, payloads)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.remove_boilerplate(docs).select("doc_id", "text", "n_lines", "n_removed")


_OWN = (op1_token_counts, op2_virtual_slots, op3_language_id, op4_setsketch, op5_projection_forest, op6_warc_archive, op7_suffix_array, op8_decontamination, op9_bpe_codec, op10_line_dedup)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OWN}
#: Where SQL can express an operator: DuckDB's form of the same rows.
ORACLES: dict[str, str] = {"op10_line_dedup": line_dedup.oracle()}
