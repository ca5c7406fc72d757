"""A training-data pipeline: each stage calls one operator on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genospark.llm import bpe_codec, decontamination, language_id, line_dedup, setsketch_dedup
from genospark.llm.queries import table, vocabulary
from genospark.llm.storage import Scratch, bound_batches
from genospark.shipping import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others, without text or letters, go. A missing lang is filled with the prediction.

    Without any labelled row to learn from, documents with letters stay as they are.
    """
    ship(spark)
    bound_batches(spark)
    model = language_id.learn_from_documents(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language_id.predict(docs, model).where(F.col("lang_pred") != language_id.UNDETERMINED)
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sources; n_chars follows the text.

    A null text stays null, a text of such lines alone becomes empty, and both stay in the table. Documents without source are cleaned but
    count for no line. Repeated rows are each cleaned; an empty table gives an empty one.
    """
    ship(spark)
    return line_dedup.remove_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; of repeated rows, one.

    Documents without text or words are like no other and stay, as do rows without doc_id. Of rows that share a kept doc_id, each text
    stays once. An empty table gives an empty one.
    """
    ship(spark)
    kept = setsketch_dedup.near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    chosen = docs.join(kept.hint("merge"), docs["doc_id"] == F.col("__id")).drop("__id").dropDuplicates(["doc_id", "text"])
    return chosen.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts stay, repeated rows and rows without doc_id are judged each for itself, and an empty table, of documents or of the
    benchmark, takes nothing away.
    """
    ship(spark)
    bound_batches(spark)
    return decontamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and input_ids of each document.

    Null and empty texts have no ids and 0 tokens; every row stays, repeated ones and those with nulls too; an empty table gives an empty one.
    """
    ship(spark)
    bound_batches(spark)
    ids = bpe_codec.encoded(docs["text"], vocabulary(bpe_codec.VOCABULARY)).alias("input_ids")
    return docs.select("doc_id", "lang", "source", ids).select("doc_id", "lang", "source", F.size("input_ids").alias("n_tokens"), "input_ids")


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontaminated), ("bpe_codec", encoded)]

#: SQL cannot express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written as a table and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            scratch.drop(*[earlier for earlier, _ in STAGES[:n]])
    return docs
