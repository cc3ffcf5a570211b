"""A training-corpus pipeline: each stage calls one operator of ``windrose.llm`` and its decisions take effect.

Every function takes (spark, docs, sf_dir). All but the last return the columns of ``documents``. Null texts fail the quality
rules and go; an empty table goes through all stages as one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.llm import bpe, decontamination, jaccard_join, line_dedup, quality_outliers
from windrose.llm.common import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    named = docs.withColumn("__text", F.xxhash64("text"))
    judged = quality_outliers.quality_outliers(named.select("doc_id", "text", "lang", "source", "__text"))
    rejected = judged.where("not kept").select(F.col("doc_id").alias("__id"), F.col("__text").alias("__hash")).distinct()
    match = named["doc_id"].eqNullSafe(rejected["__id"]) & (named["__text"] == rejected["__hash"])
    return named.join(rejected, match, "left_anti").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages of three lines go."""
    out = line_dedup.line_dedup(docs, removed="__removed").drop("__removed")
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share four fifths of their five-word strings, the smallest id stays."""
    found = jaccard_join.jaccard_join(docs.select("doc_id", "text"), n=5, percent=80)
    copies = found.where("component_id != doc_id").select(F.col("doc_id").alias("__copy")).distinct()
    return docs.join(copies, docs["doc_id"] == copies["__copy"], "left_anti")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", leaks), ("byte-level BPE", tokens)]
#: The quality estimate and edit distances are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"  # a run never writes over another's tables
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
