"""Sales trends over a stream of sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_sales(sales: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Orders, revenue, average and (approximate) buyers per day.

    ``sales`` carries ``ts``, ``CustomerID`` and ``Amount``.  An exact distinct
    count is not offered on streams; ``daily_buyers`` gives the exact pairs.
    """
    days = sales.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"))
    return days.agg(
        F.count("*").alias("DailyOrders"),
        F.sum("Amount").alias("DailyRevenue"),
        F.avg("Amount").alias("AverageOrderValue"),
        F.approx_count_distinct("CustomerID").alias("DailyCustomers"),
    ).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("Date"),
        "DailyOrders", "DailyRevenue", "AverageOrderValue", "DailyCustomers",
    )


def daily_buyers(sales: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each (day, customer) once; counting its rows per day is exact."""
    days = sales.select(F.date_trunc("day", "ts").alias("Day"), "CustomerID")
    return days.withWatermark("Day", lateness).dropDuplicatesWithinWatermark(["Day", "CustomerID"])
