"""A training-data pipeline over `documents`, stage by stage; every stage's output is written and read again.

1. quality: documents that the rules reject go.
2. near_duplicates: one document of each group of near copies (Jaccard similarity of five-word
   shingles of 0.8 or more, directly or by a chain) stays: the one with the smallest doc_id,
   or any of them where all ids are null. Different texts of one doc_id are documents of their own.
3. decontamination: documents with a benchmark window go.
4. mixing: small sources are repeated, up to twice, so that no document is left out; a document that
   is taken for two passes is in the result twice.
5. sharding: all rows in 16 interleaved shards, with shard and slot.

Null ids, null and empty texts, repeated rows, empty tables and further columns are treated as the
operators' docstrings say. Documents without words are rejected by the first stage. Rows of equal
doc_id and text are one document for the second stage, and one of them stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import decontamination, mixing, near_dedup, quality, sharding
from claimloom.llm.common import new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.host_quality(docs).filter("kept").select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(docs, percent=80, one_each=True).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.without_leaks(docs, bench)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.temperature_mix(docs).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.interleave(docs).select(*docs.columns, F.col("shard"), F.col("slot"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; their outputs go to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Near duplicates need components of a graph of similar sets; see tests/llm for the brute-force version.
ORACLE_SQL = None
