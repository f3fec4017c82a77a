"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's docs.

Language ID (rejected texts go), near-duplicates (one document of each class stays),
benchmark decontamination (documents with a benchmark passage go), mixing (documents as
often as the mix takes them) and sharding (a shard and a slot for each). All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _frame, curriculum, decontaminate, langid, minhash, reshard


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from docs' own labels; documents that it rejects go, so those without a letter (null, empty) do.

    Repeated rows share their fate; a null doc_id or lang is no reason to go; of an empty table nothing stays.
    """
    return langid.keep_identified(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate class stays."""
    return minhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; those without words, null ones too, stay.

    Repeated rows share their fate; items without words match nothing; an empty benchmark takes nothing away.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return curriculum.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards; doc_id, size, text_crc32, shard and slot of every document in them."""
    return reshard.listing(reshard.reshard(docs, _frame.temporary_folder(spark, "shards")))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: Language models, hashing and flows have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _frame.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
