"""A training corpus from raw documents: quality, near copies, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on, written as Parquet and read again for the
next.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm import decontaminate, near_dup, packing, personal, quality
from ledgerlane.llm.tables import read, row_key, scratch, spare

QUALITY_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the whole table of documents, whatever came before.

    Null texts are scored as empty ones, null and repeated ids row by row, and equal texts alike.  No rows: none.
    """
    weights = quality.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), quality.Settings())
    return docs.where(quality.score_column(weights, quality.Settings(), spark) >= QUALITY_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), the one with the smallest id.

    Rows are told apart by id and text: where an id is repeated with other texts, each goes or stays by itself.  Rows that
    share their group's smallest id all stay, equal ones too.  Null and empty texts and null ids are no copies and stay.
    """
    found = near_dup.near_duplicates(docs, near_dup.AT_80, scratch(spark, "pipeline-copies"))
    key = spare("row", docs.columns)
    gone = found.where(~F.col("kept")).select(F.col("row").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(gone, key, "left_anti").select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item, row by row as ``decontaminate.clean`` says."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), decontaminate.Settings()).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null, equal rows are masked alike."""
    return personal.masked(docs, personal.Settings(), scratch(spark, "pipeline-personal"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places there.

    Null and empty texts are one token; null and repeated ids and equal rows are packed row by row.  No rows: none.
    """
    path = public_tokenizers.path
    vocabulary = packing.Vocabulary(
        path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.packed(docs, vocabulary, packing.Limits(), scratch(spark, "pipeline-packing"))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("PII", mask_personal_data),
    ("best-fit packing", pack),
]

#: Most stages can't be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    tables = scratch(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = tables.save(stage(spark, docs, sf_dir), f"stage-{n}")
    return STAGES[-1][1](spark, docs, sf_dir)
