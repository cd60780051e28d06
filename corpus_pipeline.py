"""Corpus pipeline: quality rules, language ID, near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from plumbline.llm.langid import language_filter
from plumbline.llm.neardup import drop_near_duplicates
from plumbline.llm.packing import pack
from plumbline.llm.quality import quality_filter
from plumbline.llm.storage import scratch
from plumbline.llm.suffix import deduplicate
from pyspark.sql import DataFrame, SparkSession


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents beyond the adaptive cutoffs of their language and source."""
    return quality_filter(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language isn't recognised; lang becomes the language found."""
    return language_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut all but the first occurrence of windows that repeat."""
    return deduplicate(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every piece of every document its slot in a training sequence."""
    return pack(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packing),
]

#: Language ID, near duplicates and the packing plan can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
