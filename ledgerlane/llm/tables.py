"""Reading the text tables, and the shared folder for intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.session import Scratch


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, job: str) -> Scratch:
    """A folder of its own for one run, under the folder that the cluster shares."""
    return Scratch(spark, job)


def whole(text: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text), F.lit(""))


def row_key() -> Column:
    """A hash of a row's doc_id and text: rows that share an id are different rows where their texts differ."""
    return F.xxhash64(F.col("doc_id").cast("long"), whole())


def spare(name: str, columns: list[str]) -> str:
    """The name, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
