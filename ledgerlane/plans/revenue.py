"""Revenue by week, month and year, and the bundles built of whole reports."""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.functions import calendar as C
from ledgerlane.functions.values import or_zero
from ledgerlane.operators.relational import top_k
from ledgerlane.plans import dashboard as D
from ledgerlane.plans import rollup as R
from ledgerlane.session import Scratch
from ledgerlane.sources.tables import Tables


def weekly(t: Tables, as_of: dt.datetime, k: int = 4) -> DataFrame:
    """ISO weeks; start and end are the first and last day with an order."""
    weeks = (
        t.orders.filter(C.since("OrderDate", as_of, weeks=4))
        .groupBy(C.iso_yearweek("OrderDate").alias("WeekNumber"))
        .agg(
            F.date_format(F.min("OrderDate"), C.DAY).alias("WeekStart"),
            F.date_format(F.max("OrderDate"), C.DAY).alias("WeekEnd"),
            F.count("*").alias("OrderCount"),
            or_zero(F.sum("TotalAmount")).alias("Revenue"),
            F.countDistinct("CustomerID").alias("UniqueCustomers"),
        )
    )
    return top_k(weeks, k, "-WeekNumber")


def monthly(t: Tables, as_of: dt.datetime, k: int = 12) -> DataFrame:
    return D.monthly(t, as_of, k).select(
        "Month",
        F.substring("Month", 1, 4).alias("Year"),
        F.substring("Month", 6, 2).alias("MonthNumber"),
        "OrderCount", "Revenue", "UniqueCustomers",
    )


def yearly(t: Tables, k: int = 5) -> DataFrame:
    years = t.orders.groupBy(F.year("OrderDate").alias("Year")).agg(
        F.count("*").alias("OrderCount"),
        or_zero(F.sum("TotalAmount")).alias("Revenue"),
        F.countDistinct("CustomerID").alias("UniqueCustomers"),
    )
    return top_k(years, k, "-Year")


def summary(t: Tables, as_of: dt.datetime) -> DataFrame:
    spans = {"Week": 7, "Month": 30, "Year": 365}
    recent = {name: C.since("OrderDate", as_of, days=days) for name, days in spans.items()}
    amount = F.col("TotalAmount")
    return t.orders.select("OrderDate", "TotalAmount").agg(
        *(or_zero(F.sum(F.when(recent[n], amount))).alias(f"This{n}Revenue") for n in spans),
        *(F.count_if(recent[n]).alias(f"This{n}Orders") for n in spans),
        or_zero(F.avg(amount)).alias("AverageOrderValue"),
        or_zero(F.max(amount)).alias("HighestOrderValue"),
    )


def stored_rollup(t: Tables) -> DataFrame:
    """The rollup of all orders, written once so that every report of a bundle reads days instead of orders."""
    return Scratch(t.orders.sparkSession, "rollup").save(R.sales_rollup(t.orders), "sales")


def bundle(t: Tables, as_of: dt.datetime, rollup: DataFrame | None = None) -> dict[str, DataFrame]:
    days = stored_rollup(t) if rollup is None else rollup
    return {
        "weekly": R.weekly(days, as_of),
        "monthly": R.monthly_revenue(days, as_of),
        "yearly": R.yearly(days),
        "summary": R.summary(days, as_of),
    }


def full_dashboard(t: Tables, as_of: dt.datetime, rollup: DataFrame | None = None) -> dict[str, DataFrame]:
    """All thirteen sections, revenue as its own bundle of four.

    Orders are read for the rollup, unless a stored one is given, and for the best customers.
    """
    days = stored_rollup(t) if rollup is None else rollup
    return {
        "overview": D.overview(t, as_of, R.order_totals(days, as_of)),
        "monthlyStats": R.monthly(days, as_of),
        "topBooks": D.top_books(t),
        "topCustomers": D.top_customers(t),
        "lowStockBooks": D.low_stock(t),
        "genreStats": D.genres(t),
        "supplierStats": D.suppliers(t),
        "inventoryStats": D.inventory(t),
        "customerGrowth": R.customer_growth(days, as_of),
        "salesTrends": R.sales_trends(days, as_of),
        "orderStatusStats": R.order_recency(days, as_of),
        "newBooksStats": D.new_books(t),
        **{f"revenueStats.{name}": frame for name, frame in bundle(t, as_of, days).items()},
    }


@contextmanager
def shared_scans(t: Tables):
    """The tables with the inputs most sections read kept between actions.

    Orders shrink to the four columns the sections use, order lines to one row
    per book.  A lost cached block is computed again from its source.
    """
    orders = t.orders.select("OrderID", "CustomerID", "OrderDate", "TotalAmount").persist()
    lines = t.order_details.select("BookID", "Quantity", "Price").persist()
    try:
        yield t.replace(orders=orders, order_details=lines)
    finally:
        orders.unpersist()
        lines.unpersist()


def dashboard_document(t: Tables, as_of: dt.datetime) -> DataFrame:
    """Every section as rows of (Section, Row), each row in JSON.

    One plan, so equal shuffles are planned once and reused.
    """
    return _as_json(full_dashboard(t, as_of))


def top_views(t: Tables, as_of: dt.datetime, k: int = 5, months: int = 6) -> dict[str, DataFrame]:
    """The short lists shown first: five entries each, six months."""
    by_revenue = "-TotalRevenue"
    return {
        "topBooks": D.top_books(t, k),
        "topCustomers": D.top_customers(t, k),
        "lowStockBooks": D.low_stock(t, k),
        "supplierStats": top_k(D.suppliers(t), k, by_revenue, "-BookCount", "SupplierID"),
        "genreStats": top_k(D.genres(t), k, by_revenue, "-TotalSold", "Genre"),
        "monthlyStats": D.monthly(t, as_of, months),
    }


def export_report(t: Tables, as_of: dt.datetime) -> dict[str, DataFrame]:
    """The sections of the downloadable report, to be written with ``write_json``."""
    sections = full_dashboard(t, as_of)
    wanted = ("overview", "topBooks", "topCustomers", "lowStockBooks")
    return {
        name: frame for name, frame in sections.items()
        if name in wanted or name.startswith("revenueStats.")
    }


def report_document(sections: dict[str, DataFrame]) -> DataFrame:
    return _as_json(sections)


def _as_json(sections: dict[str, DataFrame]) -> DataFrame:
    rows = [
        frame.select(F.lit(name).alias("Section"), F.to_json(F.struct(*frame.columns)).alias("Row"))
        for name, frame in sections.items()
    ]
    united = rows[0]
    for frame in rows[1:]:
        united = united.unionByName(frame)
    return united


#: What tells the rows of a section apart; sections not named have one row.
SECTION_KEYS = {
    "weekly": "WeekNumber", "monthly": "Month", "yearly": "Year", "monthlyStats": "Month", "topBooks": "BookID",
    "topCustomers": "CustomerID", "lowStockBooks": "BookID", "genreStats": "Genre", "supplierStats": "SupplierID",
    "customerGrowth": "Month", "salesTrends": "Date", "orderStatusStats": "Code",
}


def values_document(sections: dict[str, DataFrame]) -> DataFrame:
    """Every value of every section as a row (Section, Key, Name, Number, Text), for comparing and charting."""

    def value(frame: DataFrame, name: str):
        kind = frame.schema[name].dataType
        if isinstance(kind, T.NumericType):
            number, text = F.col(name).cast("double"), F.lit(None).cast("string")
        else:
            number = F.lit(None).cast("double")
            text = F.date_format(name, C.DAY) if isinstance(kind, T.DateType) else F.col(name).cast("string")
        return F.struct(F.lit(name).alias("Name"), number.alias("Number"), text.alias("Text"))

    united = None
    for section, frame in sections.items():
        key = SECTION_KEYS.get(section.rpartition(".")[2])
        own = frame.select(
            F.lit(section).alias("Section"), (F.col(key).cast("string") if key else F.lit("")).alias("Key"),
            F.inline(F.array(*(value(frame, c) for c in frame.columns))))
        united = own if united is None else united.unionByName(own)
    return united


def write_json(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per section; each write is its own distributed job."""
    for name, frame in sections.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")
