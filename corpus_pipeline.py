"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All stages but
the last return the columns of `documents`.

1. language: texts without a language that was learned go; lang is predicted.
2. toxicity: texts scored 0.5 or more go.
3. near_duplicates: of documents linked by shingles, the smallest id stays.
4. repeats: strings of 50 bytes that an earlier document holds are removed.
5. packing: texts are cut into tokens and packed into sequences.

The tests hold stages against brute force; SQL can't express all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echofold.llm import language_id, packing, shingle_join, suffix_dedup, toxicity
from echofold.llm._common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.stage(spark, docs, sf_dir)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.stage(spark, docs, sf_dir)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.stage(spark, docs, sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("toxicity", not_toxic),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
