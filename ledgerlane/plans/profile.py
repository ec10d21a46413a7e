"""How well stored tables keep their declared rules: widths, bounds, required values, codes.

All rules of a table are one aggregate over one scan of the columns they name, with a partial step in each task, so a row
of numbers per task is all that is shuffled.  A rule on a null value holds, as it does in SQL; ``given`` asks for values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane import schema as S
from ledgerlane.sources.tables import Tables


@dataclass(frozen=True)
class Rule:
    column: str
    name: str
    broken: Column


def given(*columns: str) -> list[Rule]:
    return [Rule(c, "given", F.col(c).isNull()) for c in columns]


def width(most: int, *columns: str) -> list[Rule]:
    """At most so many characters."""
    return [Rule(c, f"width_{most}", F.char_length(c) > most) for c in columns]


def money(*columns: str) -> list[Rule]:
    """At most ten digits, two of them behind the point; the declared type sees to those."""
    return [Rule(c, "decimal_10_2", F.abs(c) >= 100_000_000) for c in columns]


def at_least(least: int, *columns: str) -> list[Rule]:
    return [Rule(c, f"at_least_{least}", F.col(c) < least) for c in columns]


def one_of(column: str, codes: tuple[str, ...]) -> list[Rule]:
    return [Rule(column, "one_of", ~F.col(column).isin(*codes))]


def declared() -> dict[str, tuple[str, list[Rule]]]:
    """The key and the rules of each table.  Fixed values: the declared widths, bounds and codes."""
    return {
        "books": ("BookID", [
            *width(100, "Title", "Author", "Genre"), *money("Price"), *at_least(0, "Stock", "InputQuantity", "OutputQuantity")]),
        "customers": ("CustomerID", [*width(50, "Name"), *width(100, "Email"), *width(10, "Phone")]),
        "suppliers": ("SupplierID", [*width(100, "Name"), *width(10, "Phone")]),
        "orders": ("OrderID", [
            *money("SubTotal", "DiscountAmount", "TotalAmount"), *one_of("PaymentStatus", S.PAYMENT_STATUSES),
            *width(100, "TransactionID")]),
        "order_details": ("OrderID", [*given("OrderID", "BookID"), *at_least(1, "Quantity"), *money("Price")]),
        "promotions": ("PromotionID", [
            *given("PromotionCode", "PromotionName", "DiscountType", "DiscountValue", "StartDate", "EndDate"),
            *width(20, "PromotionCode"), *width(100, "PromotionName"), *one_of("DiscountType", S.DISCOUNT_TYPES),
            *money("DiscountValue", "MinimumOrderAmount", "MaximumDiscount"),
            Rule("DiscountValue", "above_0", F.col("DiscountValue") <= 0),
            Rule("EndDate", "not_before_start", F.col("EndDate") < F.col("StartDate")),
            Rule("UsageLimit", "above_0", F.col("UsageLimit") <= 0), *at_least(0, "UsedCount")]),
        "promotion_types": ("TypeID", [*given("TypeName"), *width(50, "TypeName")]),
        "promotion_targets": ("TargetID", [*given("PromotionID", "TargetType"), *one_of("TargetType", S.TARGET_TYPES)]),
        "payment_methods": ("PaymentMethodID", [*given("MethodName"), *width(50, "MethodName")]),
        "promotion_usage": ("UsageID", [
            *given("PromotionID", "OrderID", "CustomerID", "DiscountAmount"), *money("DiscountAmount")]),
    }


def profile(df: DataFrame, table: str, key: str, rules: list[Rule]) -> DataFrame:
    """Table, Column, Rule, Rows, Violations, FirstKey, LastKey: a row for each rule, also over an empty table.

    The keys are the least and the greatest of the rows that break the rule; null where none does or none has a key.
    """
    counts = [F.count("*").alias("rows")]
    for n, rule in enumerate(rules):
        bad_key = F.when(rule.broken, F.col(key).cast("long"))
        counts += [F.count_if(rule.broken).alias(f"n{n}"), F.min(bad_key).alias(f"a{n}"), F.max(bad_key).alias(f"b{n}")]
    each = F.array(*(F.struct(
        F.lit(table).alias("Table"), F.lit(rule.column).alias("Column"), F.lit(rule.name).alias("Rule"),
        F.col("rows").alias("Rows"), F.col(f"n{n}").alias("Violations"), F.col(f"a{n}").alias("FirstKey"),
        F.col(f"b{n}").alias("LastKey")) for n, rule in enumerate(rules)))
    return df.agg(*counts).select(F.inline(each))


def constraint_profile(t: Tables) -> DataFrame:
    """The profiles of all tables."""
    parts = [profile(getattr(t, table), table, key, rules) for table, (key, rules) in declared().items()]
    return reduce(DataFrame.unionByName, parts)
