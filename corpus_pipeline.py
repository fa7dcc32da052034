"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Odd rows follow the operators' rules in every stage: null or empty texts are documents like others (the
classifier scores them, then they are copies of one another), null identifiers come last in any choice,
repeated rows are copies, an empty table passes through all stages, and extra columns are carried up to
the last one. A stage's folder and its operator's tables are deleted once the next stage is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reelframe.llm.common import freed, remove, shared_dir, table
from reelframe.llm.exact_dedup import drop_exact_duplicates
from reelframe.llm.mixing import mix
from reelframe.llm.packing import pack
from reelframe.llm.quality_classifier import keep_good
from reelframe.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, shard by shard."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of tokens, with the ids themselves."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash", near), ("mixing", mixed), ("packing", packed)]

#: Tokenizing, hashing and training can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/reelframe-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with freed(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove(spark, f"{base}/{before}")
        before = name
    out = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written by now
    remove(spark, base)
    return out
