"""Orders: lists, look-ups, line details and totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.values import blank, or_zero
from ledgerlane.operators.relational import having_key, listing, lookup
from ledgerlane.plans.dashboard import line_amount
from ledgerlane.sources.tables import Tables

NEWEST_FIRST = ("-OrderDate", "-OrderID")


def with_item_count(t: Tables, orders: DataFrame, some: bool = False) -> DataFrame:
    """Orders with their number of lines; of ``some`` orders only their own lines are counted."""
    lines = having_key(t.order_details, orders, "OrderID") if some else t.order_details
    counts = lines.groupBy("OrderID").agg(F.count("BookID").alias("TotalItems"))
    joined = orders.join(counts, "OrderID", "left")
    return joined.withColumn("TotalItems", or_zero(F.col("TotalItems")))


def _with_customer(t: Tables, orders: DataFrame, email: bool = True) -> DataFrame:
    columns = [F.col("Name").alias("CustomerName")]
    if email:
        columns.append(F.col("Email").alias("CustomerEmail"))
    return orders.join(t.customers.select("CustomerID", *columns), "CustomerID", "left")


def order_list(t: Tables, ordered: bool = False) -> DataFrame:
    """All orders with customer, line count, payment method and promotion.

    Payment methods are a handful of rows; promotions may be many, so how to
    join them is left to their measured size.
    """
    methods = t.payment_methods.select(
        "PaymentMethodID", F.col("MethodName").alias("PaymentMethodName")
    )
    promotions = t.promotions.select("PromotionID", "PromotionCode", "PromotionName")
    named = _with_customer(t, with_item_count(t, t.orders)).join(methods, "PaymentMethodID", "left")
    full = lookup(named, promotions, "PromotionID", -1 - F.col("OrderID"))
    return listing(full, NEWEST_FIRST, ordered)


def order_lookup(t: Tables, keys: DataFrame) -> DataFrame:
    return _with_customer(t, having_key(t.orders, keys, "OrderID"))


def order_details(t: Tables, keys: DataFrame) -> DataFrame:
    """The lines of the given orders with title, author and today's price."""
    books = t.books.select("BookID", "Title", "Author", F.col("Price").alias("BookPrice"))
    return having_key(t.order_details, keys, "OrderID").join(books, "BookID", "left")


def orders_between(
    t: Tables, first: dt.date, last: dt.date, ordered: bool = False
) -> DataFrame:
    chosen = t.orders.filter(F.col("OrderDate").between(F.lit(first), F.lit(last)))
    full = _with_customer(t, with_item_count(t, chosen, some=True), email=False)
    return listing(full, NEWEST_FIRST, ordered)


def order_stats(t: Tables) -> DataFrame:
    return t.orders.agg(
        F.count("*").alias("TotalOrders"),
        or_zero(F.sum("TotalAmount")).alias("TotalRevenue"),
        F.avg("TotalAmount").alias("AverageOrderValue"),
        F.countDistinct("CustomerID").alias("UniqueCustomers"),
    )


def line_totals(t: Tables) -> DataFrame:
    return t.order_details.withColumn("LineTotal", line_amount())


def counted_lines(lines: DataFrame) -> DataFrame:
    """Lines that count towards an order: with a book and a positive quantity."""
    return lines.filter(~blank("BookID") & (F.col("Quantity") > 0))


def order_subtotals(lines: DataFrame) -> DataFrame:
    return counted_lines(lines).groupBy("OrderID").agg(F.sum(line_amount()).alias("SubTotal"))


def order_totals(t: Tables) -> DataFrame:
    """Subtotal of the lines less the discount of the order."""
    orders = t.orders.select("OrderID", "DiscountAmount")
    joined = orders.join(order_subtotals(t.order_details), "OrderID", "left")
    subtotal = or_zero(F.col("SubTotal"))
    return joined.select(
        "OrderID",
        subtotal.alias("SubTotal"),
        "DiscountAmount",
        (subtotal - or_zero(F.col("DiscountAmount"))).alias("Total"),
    )


def stock_shortfall(t: Tables) -> DataFrame:
    """Lines asking for more than is in stock; an unknown book has none."""
    books = t.books.select("BookID", "Title", "Stock")
    lines = t.order_details.select("OrderID", "BookID", "Quantity").filter(~blank("BookID"))
    stock = or_zero(F.col("Stock"))
    joined = lines.join(books, "BookID", "left").filter(F.col("Quantity") > stock)
    return joined.withColumn("Stock", stock)
