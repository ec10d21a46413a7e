"""Small tables for the tests of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def documents(spark: SparkSession, rows: list[tuple], extra: str = "") -> DataFrame:
    """Rows of (doc_id, text), or with lang, source and n_chars too; ``extra`` names columns that hold nulls."""
    full = [(*r, *([None] * (5 - len(r)))) for r in rows]
    df = spark.createDataFrame(full, COLUMNS)
    for name in extra.split():
        df = df.withColumn(name, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))
    return df


def collected(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
