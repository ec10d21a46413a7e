"""A stored rollup of orders from which every period report is merged, with exact numbers of buyers.

A row stands for a day and a block of customer numbers.  It has the day's orders and revenue of that block and a bitmap of
its buyers.  Bitmaps of the same block are united when days are merged into weeks, months or years, so buyers are counted
exactly and never twice, and a report reads days and blocks instead of orders.

A refresh works out the months that new or changed orders fall on from the orders of those months, and overwrites just
their folders; running it again changes nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.functions import calendar as C
from ledgerlane.functions.values import or_zero
from ledgerlane.operators.relational import having_key, top_k
from ledgerlane.schema import RECENCY_LABELS

#: Customer numbers of a block: the bits of one of Spark's bitmaps.
BLOCK = 32_768


def sales_rollup(orders: DataFrame) -> DataFrame:
    """OrderDate, Block, Orders, Priced (orders with a total), Revenue, Largest, Buyers (a bitmap).

    Orders without a customer have a null block and no buyers.
    """
    block = F.floor(F.col("CustomerID") / BLOCK).cast("long").alias("Block")
    amount = F.col("TotalAmount")
    return orders.groupBy("OrderDate", block).agg(
        F.count("*").alias("Orders"), F.count(amount).alias("Priced"), F.sum(amount).alias("Revenue"),
        F.max(amount).alias("Largest"), F.bitmap_construct_agg(F.pmod("CustomerID", F.lit(BLOCK))).alias("Buyers"),
    )


def _month() -> Column:
    return F.date_format("OrderDate", C.MONTH)


def write_rollup(rollup: DataFrame, path: str) -> None:
    """A folder for each month.  Months that are there already are replaced, others stay."""
    rollup.withColumn("Folder", _month()).repartition("Folder").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("Folder").parquet(path)


def read_rollup(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored rollup; ``like`` is a rollup of the same orders, for the schema."""
    schema = T.StructType([*like.schema.fields, T.StructField("Folder", T.StringType())])
    return spark.read.schema(schema).parquet(path).drop("Folder")


def refresh(path: str, orders: DataFrame, changed: DataFrame) -> None:
    """Bring the stored months up to date in which ``changed`` orders fall; ``orders`` are all orders, changed ones too.

    An order that moves to another month must be in ``changed`` with both days.
    """
    touched = having_key(orders.withColumn("_month", _month()), changed.select(_month().alias("_month")), "_month")
    write_rollup(sales_rollup(touched), path)


def by_period(rollup: DataFrame, period: Column, name: str) -> DataFrame:
    """(name, OrderCount, Revenue, UniqueCustomers, Priced, First, Last) of each period: first by block, to unite bitmaps."""
    blocks = rollup.groupBy(period.alias(name), "Block").agg(
        F.sum("Orders").alias("_orders"), F.sum("Priced").alias("_priced"), F.sum("Revenue").alias("_revenue"),
        F.min("OrderDate").alias("_first"), F.max("OrderDate").alias("_last"),
        F.bitmap_or_agg("Buyers").alias("_buyers"),
    )
    return blocks.groupBy(name).agg(
        F.sum("_orders").alias("OrderCount"), or_zero(F.sum("_revenue")).alias("Revenue"),
        or_zero(F.sum(F.bitmap_count("_buyers"))).alias("UniqueCustomers"), F.sum("_priced").alias("Priced"),
        F.min("_first").alias("First"), F.max("_last").alias("Last"),
    )


PERIOD = ("OrderCount", "Revenue", "UniqueCustomers")


def _average(revenue: Column, priced: Column) -> Column:
    return or_zero(F.try_divide(revenue, priced).cast("decimal(22,6)"))


def monthly(rollup: DataFrame, as_of: dt.datetime, k: int = 12) -> DataFrame:
    recent = rollup.filter(C.since("OrderDate", as_of, months=12))
    return top_k(by_period(recent, F.date_format("OrderDate", C.MONTH), "Month").select("Month", *PERIOD), k, "-Month")


def monthly_revenue(rollup: DataFrame, as_of: dt.datetime, k: int = 12) -> DataFrame:
    return monthly(rollup, as_of, k).select(
        "Month", F.substring("Month", 1, 4).alias("Year"), F.substring("Month", 6, 2).alias("MonthNumber"), *PERIOD)


def weekly(rollup: DataFrame, as_of: dt.datetime, k: int = 4) -> DataFrame:
    recent = rollup.filter(C.since("OrderDate", as_of, weeks=4))
    weeks = by_period(recent, C.iso_yearweek("OrderDate"), "WeekNumber").select(
        "WeekNumber", F.date_format("First", C.DAY).alias("WeekStart"), F.date_format("Last", C.DAY).alias("WeekEnd"), *PERIOD)
    return top_k(weeks, k, "-WeekNumber")


def yearly(rollup: DataFrame, k: int = 5) -> DataFrame:
    return top_k(by_period(rollup, F.year("OrderDate"), "Year").select("Year", *PERIOD), k, "-Year")


def customer_growth(rollup: DataFrame, as_of: dt.datetime) -> DataFrame:
    recent = rollup.filter(C.since("OrderDate", as_of, months=12))
    return by_period(recent, F.date_format("OrderDate", C.MONTH), "Month").select(
        "Month", F.col("UniqueCustomers").alias("NewCustomers"), F.col("OrderCount").alias("TotalOrders"),
        F.col("Revenue").alias("TotalRevenue"))


def sales_trends(rollup: DataFrame, as_of: dt.datetime, k: int = 30) -> DataFrame:
    recent = rollup.filter(C.since("OrderDate", as_of, days=30))
    days = by_period(recent, F.date_format("OrderDate", C.DAY), "Date").select(
        "Date", F.col("OrderCount").alias("DailyOrders"), F.col("Revenue").alias("DailyRevenue"),
        F.col("UniqueCustomers").alias("DailyCustomers"), _average(F.col("Revenue"), F.col("Priced")).alias("AverageOrderValue"))
    return top_k(days, k, "-Date")


def sales_chart(rollup: DataFrame, as_of: dt.datetime, period: str = "month") -> DataFrame:
    span, pattern = ({"months": 12}, C.MONTH) if period == "month" else ({"days": 30}, C.DAY)
    recent = rollup.filter(C.since("OrderDate", as_of, **span))
    return by_period(recent, F.date_format("OrderDate", pattern), "Period").select("Period", *PERIOD)


def _recent_orders(recent: Column) -> Column:
    return or_zero(F.sum(F.when(recent, F.col("Orders"))))


def _recent_revenue(recent: Column) -> Column:
    return or_zero(F.sum(F.when(recent, F.col("Revenue"))))


def summary(rollup: DataFrame, as_of: dt.datetime) -> DataFrame:
    spans = {"Week": 7, "Month": 30, "Year": 365}
    recent = {name: C.since("OrderDate", as_of, days=days) for name, days in spans.items()}
    return rollup.agg(
        *(_recent_revenue(recent[n]).alias(f"This{n}Revenue") for n in spans),
        *(_recent_orders(recent[n]).alias(f"This{n}Orders") for n in spans),
        _average(F.sum("Revenue"), F.sum("Priced")).alias("AverageOrderValue"),
        or_zero(F.max("Largest")).alias("HighestOrderValue"),
    )


def order_recency(rollup: DataFrame, as_of: dt.datetime) -> DataFrame:
    tests = {
        "all": F.lit(True),
        "last_30_days": C.since("OrderDate", as_of, days=30),
        "last_7_days": C.since("OrderDate", as_of, days=7),
        "today": F.col("OrderDate") == F.lit(as_of.date()),
    }
    totals = rollup.agg(*(
        F.struct(
            F.lit(code).alias("Code"), F.lit(label).alias("Status"),
            _recent_orders(tests[code]).alias("Count"), _recent_revenue(tests[code]).alias("TotalValue"),
        ).alias(code)
        for code, label in RECENCY_LABELS
    ))
    return totals.select(F.inline(F.array(*(code for code, _ in RECENCY_LABELS))))


def order_totals(rollup: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The orders' part of the overview."""
    recent = C.since("OrderDate", as_of, days=30)
    blocks = rollup.groupBy("Block").agg(
        F.sum("Orders").alias("_orders"), F.sum("Revenue").alias("_revenue"), F.bitmap_or_agg("Buyers").alias("_buyers"),
        _recent_orders(recent).alias("_recent"), _recent_revenue(recent).alias("_recent_revenue"))
    return blocks.agg(
        or_zero(F.sum("_orders")).alias("TotalOrders"), or_zero(F.sum("_revenue")).alias("TotalRevenue"),
        or_zero(F.sum(F.bitmap_count("_buyers"))).alias("ActiveCustomers"),
        or_zero(F.sum("_recent")).alias("OrdersThisMonth"), or_zero(F.sum("_recent_revenue")).alias("RevenueThisMonth"))


def daily(rollup: DataFrame) -> DataFrame:
    """Every day with its orders, revenue and buyers."""
    return by_period(rollup, F.col("OrderDate"), "Day").select("Day", *PERIOD)
