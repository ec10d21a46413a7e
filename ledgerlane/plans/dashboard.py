"""Dashboard reports.

Each takes the table bundle and, where time matters, ``as_of``.  The many side
of a join is always aggregated by its key first: the shuffle then carries one
row per key and task, whatever the number of orders behind a key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import calendar as C
from ledgerlane.functions.values import or_zero
from ledgerlane.operators.relational import one_row, sort_keys, top_k, with_rank
from ledgerlane.schema import HIGH_STOCK, LOW_STOCK, RECENCY_LABELS
from ledgerlane.sources.tables import Tables


def stock_value() -> Column:
    return F.col("Stock") * F.col("Price")


def line_amount() -> Column:
    return F.col("Quantity") * F.col("Price")


def _orders(t: Tables) -> DataFrame:
    return t.orders.select("OrderID", "CustomerID", "OrderDate", "TotalAmount")


def _revenue(when: Column | None = None) -> Column:
    amount = F.col("TotalAmount")
    return or_zero(F.sum(amount if when is None else F.when(when, amount)))


def _by_period(orders: DataFrame, period: Column, name: str) -> DataFrame:
    return orders.groupBy(period.alias(name)).agg(
        F.count("*").alias("OrderCount"),
        _revenue().alias("Revenue"),
        F.countDistinct("CustomerID").alias("UniqueCustomers"),
    )


def sales_per_book(t: Tables) -> DataFrame:
    """Lines, units and revenue of every book that was ever sold."""
    return t.order_details.groupBy("BookID").agg(
        F.count("*").alias("Lines"),
        F.sum("Quantity").alias("TotalSold"),
        F.sum(line_amount()).alias("TotalRevenue"),
    )


def _books_with_sales(t: Tables, *columns: str) -> DataFrame:
    sold = sales_per_book(t)
    return t.books.select("BookID", *columns).join(sold, "BookID", "left")


def overview(t: Tables, as_of: dt.datetime, order_totals: DataFrame | None = None) -> DataFrame:
    """``order_totals`` are the orders' numbers where they are known already, e.g. from the rollup."""
    recent = C.since("OrderDate", as_of, days=30)
    books = t.books.agg(
        F.count("*").alias("TotalBooks"),
        or_zero(F.sum("Stock")).alias("TotalStock"),
        F.count_if(F.col("Stock") <= LOW_STOCK).alias("LowStockBooks"),
        or_zero(F.sum(stock_value())).alias("InventoryValue"),
    )
    orders = order_totals if order_totals is not None else _orders(t).agg(
        F.count("*").alias("TotalOrders"),
        _revenue().alias("TotalRevenue"),
        F.countDistinct("CustomerID").alias("ActiveCustomers"),
        F.count_if(recent).alias("OrdersThisMonth"),
        _revenue(recent).alias("RevenueThisMonth"),
    )
    return one_row(
        books,
        orders,
        t.customers.agg(F.count("*").alias("TotalCustomers")),
        t.suppliers.agg(F.count("*").alias("TotalSuppliers")),
    )


def monthly(t: Tables, as_of: dt.datetime, k: int = 12) -> DataFrame:
    recent = _orders(t).filter(C.since("OrderDate", as_of, months=12))
    months = _by_period(recent, F.date_format("OrderDate", C.MONTH), "Month")
    return top_k(months, k, "-Month")


TOP_BOOKS_ORDER = ("-TotalSold", "-TotalRevenue", "BookID")
TOP_CUSTOMERS_ORDER = ("-TotalSpent", "-OrderCount", "CustomerID")


def top_books(t: Tables, k: int = 10) -> DataFrame:
    ranked = _books_with_sales(t, "Title", "Author", "Genre", "Price").select(
        "BookID", "Title", "Author", "Genre", "Price",
        or_zero(F.col("TotalSold")).alias("TotalSold"),
        or_zero(F.col("TotalRevenue")).alias("TotalRevenue"),
    )
    return top_k(ranked, k, *TOP_BOOKS_ORDER)


def top_customers(t: Tables, k: int = 10) -> DataFrame:
    spent = _orders(t).groupBy("CustomerID").agg(
        F.count("*").alias("OrderCount"),
        F.sum("TotalAmount").alias("TotalSpent"),
        F.max("OrderDate").alias("LastOrderDate"),
    )
    ranked = t.customers.select("CustomerID", "Name", "Email").join(spent, "CustomerID", "left")
    ranked = ranked.withColumns(
        {c: or_zero(F.col(c)) for c in ("OrderCount", "TotalSpent")}
    )
    return top_k(ranked, k, *TOP_CUSTOMERS_ORDER)


def ranked_books(t: Tables, k: int = 10) -> DataFrame:
    return with_rank(top_books(t, k), *TOP_BOOKS_ORDER)


def ranked_customers(t: Tables, k: int = 10) -> DataFrame:
    return with_rank(top_customers(t, k), *TOP_CUSTOMERS_ORDER)


def low_stock(t: Tables, k: int = 10, threshold: int = LOW_STOCK) -> DataFrame:
    """The limit comes first: at most ``k`` books look up their supplier."""
    order = ("Stock", "BookID")
    scarce = t.books.filter(F.col("Stock") <= threshold).select(
        "BookID", "Title", "Author", "Genre", "Price", "Stock", "SupplierID"
    )
    names = t.suppliers.select("SupplierID", F.col("Name").alias("SupplierName"))
    named = top_k(scarce, k, *order).join(names, "SupplierID", "left").drop("SupplierID")
    return named.orderBy(*sort_keys(order))


def genres(t: Tables) -> DataFrame:
    """Per genre, counting a book and its stock once per order line it appears on.

    An unsold book counts once.  That is the reading of a join of books with
    their lines; weighting each book by its lines gives it without the join's
    blow-up.
    """
    weight = F.greatest(or_zero(F.col("Lines")), F.lit(1))
    return _books_with_sales(t, "Genre", "Stock").groupBy("Genre").agg(
        F.sum(weight).alias("BookCount"),
        or_zero(F.sum(F.col("Stock") * weight)).alias("TotalStock"),
        or_zero(F.sum("TotalSold")).alias("TotalSold"),
        or_zero(F.sum("TotalRevenue")).alias("TotalRevenue"),
    )


def genres_exact(t: Tables) -> DataFrame:
    """Per genre, each book and its stock counted once."""
    return _books_with_sales(t, "Genre", "Stock").groupBy("Genre").agg(
        F.count("BookID").alias("BookCount"),
        or_zero(F.sum("Stock")).alias("TotalStock"),
        or_zero(F.sum("TotalSold")).alias("TotalSold"),
        or_zero(F.sum("TotalRevenue")).alias("TotalRevenue"),
    )


_SUPPLIER_TOTALS = ("BookCount", "TotalStock", "InventoryValue", "TotalSold", "TotalRevenue")


def _supplier_report(t: Tables, weight: Column) -> DataFrame:
    totals = _books_with_sales(t, "SupplierID", "Stock", "Price").groupBy("SupplierID").agg(
        F.sum(weight).alias("BookCount"),
        F.sum(F.col("Stock") * weight).alias("TotalStock"),
        F.sum(stock_value() * weight).alias("InventoryValue"),
        F.sum("TotalSold").alias("TotalSold"),
        F.sum("TotalRevenue").alias("TotalRevenue"),
    )
    named = t.suppliers.select("SupplierID", F.col("Name").alias("SupplierName"), "Address", "Phone")
    joined = named.join(totals, "SupplierID", "left")
    return joined.withColumns({c: or_zero(F.col(c)) for c in _SUPPLIER_TOTALS})


def suppliers(t: Tables) -> DataFrame:
    """Per supplier, a book counted once per order line it appears on (see ``genres``)."""
    return _supplier_report(t, F.greatest(or_zero(F.col("Lines")), F.lit(1)))


def suppliers_exact(t: Tables) -> DataFrame:
    return _supplier_report(t, F.lit(1))


def inventory(t: Tables) -> DataFrame:
    stock = F.col("Stock")
    return t.books.agg(
        F.count("*").alias("TotalBooks"),
        or_zero(F.sum("Stock")).alias("TotalStock"),
        or_zero(F.sum(stock_value())).alias("TotalValue"),
        or_zero(F.avg("Price")).alias("AveragePrice"),
        F.count_if(stock <= LOW_STOCK).alias("LowStockCount"),
        F.count_if(stock == 0).alias("OutOfStockCount"),
        F.count_if(stock > HIGH_STOCK).alias("HighStockCount"),
        or_zero(F.sum(F.when(stock <= LOW_STOCK, stock_value()))).alias("LowStockValue"),
    )


def customer_growth(t: Tables, as_of: dt.datetime) -> DataFrame:
    """Distinct buyers per month over the last 12 months, new or not."""
    recent = _orders(t).filter(C.since("OrderDate", as_of, months=12))
    months = _by_period(recent, F.date_format("OrderDate", C.MONTH), "Month")
    return months.select(
        "Month",
        F.col("UniqueCustomers").alias("NewCustomers"),
        F.col("OrderCount").alias("TotalOrders"),
        F.col("Revenue").alias("TotalRevenue"),
    )


def customer_growth_exact(t: Tables, as_of: dt.datetime) -> DataFrame:
    """As ``customer_growth``, with first-time buyers as the new customers."""
    firsts = _orders(t).groupBy("CustomerID").agg(F.min("OrderDate").alias("OrderDate"))
    recent = C.since("OrderDate", as_of, months=12)
    newcomers = (
        firsts.filter(recent & F.col("CustomerID").isNotNull())
        .groupBy(F.date_format("OrderDate", C.MONTH).alias("Month"))
        .agg(F.count("*").alias("NewCustomers"))
    )
    months = customer_growth(t, as_of).drop("NewCustomers").join(newcomers, "Month", "left")
    return months.withColumn("NewCustomers", or_zero(F.col("NewCustomers")))


def sales_trends(t: Tables, as_of: dt.datetime, k: int = 30) -> DataFrame:
    days = (
        _orders(t)
        .filter(C.since("OrderDate", as_of, days=30))
        .groupBy(F.date_format("OrderDate", C.DAY).alias("Date"))
        .agg(
            F.count("*").alias("DailyOrders"),
            _revenue().alias("DailyRevenue"),
            F.countDistinct("CustomerID").alias("DailyCustomers"),
            or_zero(F.avg("TotalAmount")).alias("AverageOrderValue"),
        )
    )
    return top_k(days, k, "-Date")


def order_recency(t: Tables, as_of: dt.datetime) -> DataFrame:
    """Four overlapping buckets from one pass over the orders."""
    tests = {
        "all": F.lit(True),
        "last_30_days": C.since("OrderDate", as_of, days=30),
        "last_7_days": C.since("OrderDate", as_of, days=7),
        "today": F.col("OrderDate") == F.lit(as_of.date()),
    }
    totals = t.orders.select("OrderDate", "TotalAmount").agg(*(
        F.struct(
            F.lit(code).alias("Code"),
            F.lit(label).alias("Status"),
            F.count_if(tests[code]).alias("Count"),
            _revenue(tests[code]).alias("TotalValue"),
        ).alias(code)
        for code, label in RECENCY_LABELS
    ))
    return totals.select(F.inline(F.array(*(code for code, _ in RECENCY_LABELS))))


def new_books(t: Tables, last: int = 10) -> DataFrame:
    newest = t.books.agg((F.max("BookID") - last).alias("BookID")).scalar()
    stock = F.col("Stock")
    return t.books.filter(F.col("BookID") > newest).agg(
        F.count("*").alias("TotalNewBooks"),
        or_zero(F.sum("Stock")).alias("TotalStock"),
        or_zero(F.sum(stock_value())).alias("TotalValue"),
        or_zero(F.avg("Price")).alias("AveragePrice"),
        F.count_if(stock > 0).alias("AvailableBooks"),
        F.count_if(stock == 0).alias("OutOfStockBooks"),
    )


def recent_orders(t: Tables, k: int = 10) -> DataFrame:
    """The newest ``k`` orders; the other tables are filtered down to those.

    The limited list is the only side ever hinted for broadcast: it has ``k``
    rows by construction.
    """
    order = ("-OrderDate", "-OrderID")
    newest = top_k(_orders(t), k, *order)
    items = (
        t.order_details.join(F.broadcast(newest.select("OrderID")), "OrderID", "left_semi")
        .groupBy("OrderID")
        .agg(F.count("BookID").alias("ItemCount"))
    )
    buyers = t.customers.join(
        F.broadcast(newest.select("CustomerID")), "CustomerID", "left_semi"
    ).select("CustomerID", F.col("Name").alias("CustomerName"), F.col("Email").alias("CustomerEmail"))
    return (
        newest.join(buyers, "CustomerID", "left")
        .join(items, "OrderID", "left")
        .select(
            "OrderID", "OrderDate", "TotalAmount", "CustomerName", "CustomerEmail",
            or_zero(F.col("ItemCount")).alias("ItemCount"),
        )
        .orderBy(*sort_keys(order))
    )


def sales_chart(t: Tables, as_of: dt.datetime, period: str = "month") -> DataFrame:
    """Twelve months by month, or for any other period thirty days by day."""
    span, pattern = ({"months": 12}, C.MONTH) if period == "month" else ({"days": 30}, C.DAY)
    recent = _orders(t).filter(C.since("OrderDate", as_of, **span))
    return _by_period(recent, F.date_format("OrderDate", pattern), "Period")


def insights(t: Tables, as_of: dt.datetime) -> DataFrame:
    """Headline numbers and which of the three pieces of advice applies."""
    head = overview(t, as_of)
    average = F.when(
        (F.col("TotalRevenue") > 0) & (F.col("TotalOrders") > 0),
        F.col("TotalRevenue").cast("double") / F.col("TotalOrders"),
    ).otherwise(0.0)
    return head.select(
        "TotalRevenue", "TotalOrders", "TotalBooks", "TotalCustomers",
        F.col("LowStockBooks").alias("LowStockAlert"),
        average.alias("AverageOrderValue"),
        F.when(F.col("LowStockBooks") > 0, "restock").otherwise("stable").alias("StockAdvice"),
        F.when(F.col("TotalCustomers") > 0, "grow").otherwise("market").alias("CustomerAdvice"),
        F.when(average > 0, "cross_sell").otherwise("improve").alias("SalesAdvice"),
    )


def low_stock_share(t: Tables) -> DataFrame:
    """Whole percent of titles with low stock, 0 for an empty shop."""
    low = F.count_if(F.col("Stock") <= LOW_STOCK)
    share = F.round(F.try_divide(low * 100, F.count("*"))).cast("long")
    return t.books.agg(or_zero(share).alias("LowStockPercent"))
