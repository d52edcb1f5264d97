"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  Near
duplicates take five words and a similarity of 0.8; passages are strings of 50 bytes.  Nulls, empty texts and repeated
rows are treated as the operators' docstrings say; n_chars follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm import jaccard, lines, packing, quality, suffixes
from treeledger.runtime import checkpoint_dir, drop, ship


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    out = docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs
    return out.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain rules or the labelled lines reject go."""
    return quality.quality_filter(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and near-equal lines the first in the smallest doc_id stays; documents that had lines and lose all go."""
    return _sized(lines.dedup_lines(spark, docs).where("n_lines = 0 or n_removed < n_lines"), docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays."""
    return jaccard.keep_one(spark, docs, width=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters whose bytes all lie in passages of documents with smaller doc_id go."""
    return _sized(suffixes.dedup_passages(spark, docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: The first stage's random field and the suffix arrays have no SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again, and a table goes when the next one
    is there."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                drop(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
