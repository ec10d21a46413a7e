"""Customers and suppliers: lists, look-ups, searches and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.values import contains_any, or_zero
from ledgerlane.operators.relational import having_key, listing, top_k
from ledgerlane.plans.orders import with_item_count
from ledgerlane.sources.tables import Tables


def _customers_with_totals(t: Tables, customers: DataFrame, some: bool = False) -> DataFrame:
    """Customers with their orders' totals; of ``some`` customers only their own orders are added up."""
    orders = having_key(t.orders, customers, "CustomerID") if some else t.orders
    totals = orders.groupBy("CustomerID").agg(
        F.count("*").alias("TotalOrders"), F.sum("TotalAmount").alias("TotalSpent")
    )
    joined = customers.join(totals, "CustomerID", "left")
    return joined.withColumns({c: or_zero(F.col(c)) for c in ("TotalOrders", "TotalSpent")})


def customer_list(t: Tables, ordered: bool = False) -> DataFrame:
    return listing(_customers_with_totals(t, t.customers), ("-CustomerID",), ordered)


def customer_lookup(t: Tables, keys: DataFrame) -> DataFrame:
    return having_key(t.customers, keys, "CustomerID")


def customer_search(
    t: Tables, term: str, ordered: bool = False, accent_insensitive: bool = False
) -> DataFrame:
    found = t.customers.filter(contains_any(
        term, "Name", "Email", "Phone", accent_insensitive=accent_insensitive
    ))
    return listing(_customers_with_totals(t, found, some=True), ("-CustomerID",), ordered)


def customer_orders(t: Tables, keys: DataFrame, ordered: bool = False) -> DataFrame:
    """The orders of the given customers with their line counts."""
    theirs = having_key(t.orders, keys, "CustomerID")
    return listing(with_item_count(t, theirs, some=True), ("-OrderDate", "-OrderID"), ordered)


def customer_top(t: Tables, k: int = 10) -> DataFrame:
    ranked = _customers_with_totals(t, t.customers)
    return top_k(ranked, k, "-TotalSpent", "CustomerID")


def _suppliers_with_totals(t: Tables, suppliers: DataFrame) -> DataFrame:
    totals = t.books.groupBy("SupplierID").agg(
        F.count("*").alias("TotalBooks"), F.sum("Stock").alias("TotalStock")
    )
    joined = suppliers.join(totals, "SupplierID", "left")
    return joined.withColumns({c: or_zero(F.col(c)) for c in ("TotalBooks", "TotalStock")})


def supplier_list(t: Tables, ordered: bool = False) -> DataFrame:
    return listing(_suppliers_with_totals(t, t.suppliers), ("-SupplierID",), ordered)


def supplier_lookup(t: Tables, keys: DataFrame) -> DataFrame:
    return having_key(t.suppliers, keys, "SupplierID")


def supplier_search(
    t: Tables, term: str, ordered: bool = False, accent_insensitive: bool = False
) -> DataFrame:
    found = t.suppliers.filter(contains_any(
        term, "Name", "Address", "Phone", accent_insensitive=accent_insensitive
    ))
    return listing(_suppliers_with_totals(t, found), ("-SupplierID",), ordered)


def supplier_books(t: Tables, keys: DataFrame, ordered: bool = False) -> DataFrame:
    """The books of the given suppliers."""
    books = having_key(t.books, keys, "SupplierID")
    names = t.suppliers.select("SupplierID", F.col("Name").alias("SupplierName"))
    named = books.join(names, "SupplierID", "left").select(*books.columns, "SupplierName")
    return listing(named, ("-BookID",), ordered)


def supplier_top(t: Tables, k: int = 5) -> DataFrame:
    ranked = _suppliers_with_totals(t, t.suppliers)
    return top_k(ranked, k, "-TotalBooks", "-TotalStock", "SupplierID")


def _books_per_supplier(t: Tables) -> DataFrame:
    totals = t.books.groupBy("SupplierID").agg(
        F.count("*").alias("Books"), F.sum("Stock").alias("Stock")
    )
    return t.suppliers.select("SupplierID").join(totals, "SupplierID", "left")


def supplier_stats(t: Tables) -> DataFrame:
    """Totals that count a supplier once per book (and once without any)."""
    books = or_zero(F.col("Books"))
    return _books_per_supplier(t).agg(
        or_zero(F.sum(F.greatest(books, F.lit(1)))).alias("TotalSuppliers"),
        or_zero(F.sum(books)).alias("ActiveSuppliers"),
        or_zero(F.sum("Stock")).alias("TotalStock"),
    )


def supplier_stats_exact(t: Tables) -> DataFrame:
    """Totals that count every supplier once."""
    return _books_per_supplier(t).agg(
        F.count("*").alias("TotalSuppliers"),
        F.count("Books").alias("ActiveSuppliers"),
        or_zero(F.sum("Stock")).alias("TotalStock"),
    )
