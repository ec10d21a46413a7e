"""Small column rules shared by the reports and jobs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.schema import LOW_STOCK, MONEY


def or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def blank(column: Column | str) -> Column:
    """Missing in the loose sense: null, the empty text or a plain zero."""
    column = F.col(column) if isinstance(column, str) else column
    return column.isNull() | column.cast("string").isin("", "0")


def numeric(column: Column | str) -> Column:
    """The value as an exact number, or null when it is not one."""
    column = F.col(column) if isinstance(column, str) else column
    return column.try_cast("decimal(30,6)")


def contains_any(term: str, *columns: str, accent_insensitive: bool = False) -> Column:
    """Case-insensitive substring search in any of the columns.

    ``%`` and ``_`` in the term stay wildcards.  With ``accent_insensitive``
    the term is taken literally and accents are ignored too.
    """
    if accent_insensitive:
        tests = (
            F.contains(F.collate(F.col(c), "UNICODE_CI_AI"), F.collate(F.lit(term), "UNICODE_CI_AI"))
            for c in columns
        )
    else:
        tests = (F.col(c).ilike(f"%{term}%") for c in columns)
    return reduce(or_, tests)


def first_failure(checks: Iterable[tuple[Column, str]]) -> Column:
    """The reason of the first check that holds, or null when all pass."""
    return F.coalesce(*(F.when(failed, F.lit(reason)) for failed, reason in checks))


def stock_status(stock: Column | str) -> Column:
    stock = F.col(stock) if isinstance(stock, str) else stock
    return F.when(stock == 0, "out").when(stock <= LOW_STOCK, "low").otherwise("ok")


def stock_tier(stock: Column | str) -> Column:
    stock = F.col(stock) if isinstance(stock, str) else stock
    return F.when(stock > 10, "high").when(stock > 5, "medium").otherwise("low")


def current_stock(taken_in: Column, given_out: Column) -> Column:
    return F.greatest(F.lit(0), or_zero(taken_in) - or_zero(given_out))


def discount(kind: Column, value: Column, cap: Column, amount: Column) -> Column:
    """Discount on an order amount: a capped share or a fixed sum, never above the amount.

    Null without a value; ``least`` alone would then return the whole amount.
    """
    share = amount * value / 100
    capped = F.when(cap.isNotNull() & (cap != 0), F.least(share, cap)).otherwise(share)
    given = F.when(kind == "percentage", capped).otherwise(value)
    return F.when(given.isNotNull() & amount.isNotNull(), F.least(given, amount)).cast(MONEY)
