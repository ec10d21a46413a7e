"""Storing the tables so that the common joins need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlane.schema import SCHEMAS
from ledgerlane.sources.tables import Tables

#: Tables joined with one another, and the key they are clustered by.
CLUSTERED = {
    "orders": "OrderID",
    "order_details": "OrderID",
    "books": "BookID",
    "customers": "CustomerID",
}


def save_clustered(t: Tables, database: str, buckets: int, names=tuple(CLUSTERED)) -> None:
    """Save tables bucketed and sorted by key.

    Orders and their lines share the bucketing, so joining or counting lines
    per order reads matching buckets side by side.
    """
    for name in names:
        key = CLUSTERED[name]
        frame: DataFrame = getattr(t, name)
        (
            frame.repartition(buckets, key).write.mode("overwrite").format("parquet")
            .bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{name}")
        )


def save_by_date(orders: DataFrame, path: str, files: int) -> None:
    """Save orders in ranges of their date, so that date windows skip most of the data.

    The order number splits a day that is too large for one file.
    """
    ranged = orders.repartitionByRange(files, "OrderDate", "OrderID")
    ranged.sortWithinPartitions("OrderDate", "OrderID").write.mode("overwrite").parquet(path)


def save_tables(t: Tables, root: str, fmt: str = "parquet") -> None:
    """One folder per table in the layout ``read_tables`` expects."""
    for name in SCHEMAS:
        getattr(t, name).write.mode("overwrite").format(fmt).save(f"{root}/{name}")


def clustered_tables(spark: SparkSession, database: str, rest: Tables) -> Tables:
    """The saved tables, the others taken from ``rest``."""
    return rest.replace(**{name: spark.table(f"{database}.{name}") for name in CLUSTERED})
