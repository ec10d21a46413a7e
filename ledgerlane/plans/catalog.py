"""Books: lists, look-ups and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import values as V
from ledgerlane.operators.relational import having_key, listing, top_k
from ledgerlane.schema import LOW_STOCK
from ledgerlane.sources.tables import Tables

NEWEST_FIRST = ("-BookID",)


def _with_supplier(t: Tables, books: DataFrame) -> DataFrame:
    names = t.suppliers.select("SupplierID", F.col("Name").alias("SupplierName"))
    return books.join(names, "SupplierID", "left").select(*books.columns, "SupplierName")


def book_list(t: Tables, ordered: bool = False) -> DataFrame:
    return listing(_with_supplier(t, t.books), NEWEST_FIRST, ordered)


def book_lookup(t: Tables, keys: DataFrame) -> DataFrame:
    return _with_supplier(t, having_key(t.books, keys, "BookID"))


def book_search(
    t: Tables, term: str, ordered: bool = False, accent_insensitive: bool = False
) -> DataFrame:
    found = t.books.filter(V.contains_any(
        term, "Title", "Author", "Genre", accent_insensitive=accent_insensitive
    ))
    return listing(_with_supplier(t, found), NEWEST_FIRST, ordered)


def book_typeahead(t: Tables, term: str, k: int = 10) -> DataFrame:
    """The first ``k`` books with the literal term in a text column; none for a blank term."""
    if not term.strip():
        return t.books.limit(0)
    needle = F.lit(term.lower())
    hit = F.lit(False)
    for column in ("Title", "Author", "Genre"):
        hit = hit | F.contains(F.lower(column), needle)
    return top_k(t.books.filter(hit), k, "BookID")


def book_low_stock(t: Tables, threshold: int = LOW_STOCK, ordered: bool = False) -> DataFrame:
    scarce = t.books.filter(F.col("Stock") <= threshold)
    return listing(_with_supplier(t, scarce), ("Stock", "BookID"), ordered)


def stock_levels(t: Tables) -> DataFrame:
    """Status, tier and the stock implied by what came in and went out."""
    return t.books.select(
        "BookID", "Title", "Stock",
        V.stock_status("Stock").alias("StockStatus"),
        V.stock_tier("Stock").alias("StockTier"),
        V.current_stock(F.col("InputQuantity"), F.col("OutputQuantity")).alias("CurrentStock"),
    )
