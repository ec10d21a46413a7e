"""Promotions: lists and the rules that decide whether an order may use one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import values as V
from ledgerlane.operators.relational import lacking_key, listing, lookup
from ledgerlane.schema import LOYAL_ORDERS
from ledgerlane.sources.tables import Tables

NEWEST_FIRST = ("-CreatedAt", "PromotionID")


def usable(as_of: dt.datetime) -> Column:
    """Switched on, inside its dates and with uses left."""
    today = F.lit(as_of.date())
    return (
        F.col("IsActive")
        & (F.col("StartDate") <= today)
        & (F.col("EndDate") >= today)
        & (F.col("UsageLimit").isNull() | (F.col("UsedCount") < F.col("UsageLimit")))
    )


def active_promotions(t: Tables, as_of: dt.datetime, ordered: bool = False) -> DataFrame:
    """The type label is looked up by the promotion's own number, as the shop does."""
    labels = t.promotion_types.select(
        F.col("TypeID").cast("long").alias("PromotionID"), "TypeName"
    )
    active = t.promotions.filter(usable(as_of)).join(labels, "PromotionID", "left")
    return listing(active, NEWEST_FIRST, ordered)


def promotions_by_code(t: Tables, codes: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Usable promotions named by any of the codes; letter case does not matter."""
    asked = codes.select(F.upper("PromotionCode").alias("_code")).distinct()
    active = active_promotions(t, as_of).withColumn("_code", F.upper("PromotionCode"))
    return active.join(asked, "_code", "left_semi").drop("_code")


def usage_history(t: Tables, customers: DataFrame, ordered: bool = False) -> DataFrame:
    """The promotion uses of the given customers."""
    used = t.promotion_usage.join(customers.select("CustomerID"), "CustomerID", "left_semi")
    promotions = t.promotions.select("PromotionID", "PromotionCode", "PromotionName")
    full = used.join(promotions, "PromotionID").join(
        t.orders.select("OrderID", "OrderDate"), "OrderID"
    )
    return listing(full, ("-UsedAt", "-UsageID"), ordered)


def new_customers(t: Tables) -> DataFrame:
    return lacking_key(t.customers, t.orders, "CustomerID")


def loyal_customers(t: Tables, at_least: int = LOYAL_ORDERS) -> DataFrame:
    counts = t.orders.groupBy("CustomerID").agg(F.count("*").alias("OrderCount"))
    loyal = counts.filter(F.col("OrderCount") >= at_least)
    return t.customers.join(loyal, "CustomerID")


def promotion_list(t: Tables, term: str = "", ordered: bool = False) -> DataFrame:
    """Everything, or what a search finds; ``"0"`` counts as no search."""
    promotions = t.promotions
    if term not in ("", "0"):
        promotions = promotions.filter(
            V.contains_any(term, "PromotionCode", "PromotionName", "Description")
        )
    shown = promotions.withColumns({
        "UsageLimitDisplay": F.coalesce(F.col("UsageLimit").cast("string"), F.lit("∞")),
        "UsedCount": V.or_zero(F.col("UsedCount")),
    })
    return listing(shown, NEWEST_FIRST, ordered)


def with_discount(df: DataFrame, amount: str = "SubTotal") -> DataFrame:
    """Discount of a row that carries its promotion's terms; zero without one."""
    given = V.discount(
        F.col("DiscountType"), F.col("DiscountValue"), F.col("MaximumDiscount"), F.col(amount)
    )
    return df.withColumn("DiscountAmount", V.or_zero(given).cast("decimal(18,2)"))


def failing_targets(t: Tables, requests: DataFrame, lines: DataFrame) -> DataFrame:
    """Requests (OrderID, CustomerID, PromotionID) whose promotion is aimed elsewhere.

    Targets are walked in order until one decides: an ``all`` accepts, a
    customer or product that does not match refuses.  Without an order of
    steps: refused when the first failing target comes before the first
    ``all``.  Only requests with a product target meet the lines.
    """
    aimed = requests.select("OrderID", "CustomerID", "PromotionID").join(
        t.promotion_targets, "PromotionID"
    )
    kind, wanted = F.col("TargetType"), F.col("TargetID_Value")
    named = wanted.isNotNull() & (wanted != 0)
    is_product = (kind == "product") & named
    other_customer = (kind == "customer") & named & ~wanted.eqNullSafe(F.col("CustomerID"))
    products = aimed.filter(is_product).select(
        "OrderID", "TargetID", F.col("TargetID_Value").alias("BookID")
    )
    bought = (
        lines.select("OrderID", "BookID").join(products, ["OrderID", "BookID"])
        .select("OrderID", "TargetID").distinct().withColumn("_bought", F.lit(True))
    )
    fails = other_customer | (is_product & F.col("_bought").isNull())
    steps = aimed.join(bought, ["OrderID", "TargetID"], "left").select(
        "OrderID",
        F.when(F.coalesce(fails, F.lit(False)), F.col("TargetID")).alias("_fail"),
        F.when(kind == "all", F.col("TargetID")).alias("_all"),
    )
    verdict = steps.groupBy("OrderID").agg(F.min("_fail").alias("_fail"), F.min("_all").alias("_all"))
    refused = F.col("_all").isNull() | (F.col("_fail") < F.col("_all"))
    return verdict.filter(F.col("_fail").isNotNull() & refused).select("OrderID")


def validate_promotions(
    t: Tables, requests: DataFrame, lines: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """Judge each request's promotion code; the first rule that fails is the reason.

    Requests carry OrderID, CustomerID, PromotionCode and SubTotal.  The terms
    of the promotion stay on the row for the discount.
    """
    terms = t.promotions.filter(usable(as_of)).select(
        F.upper("PromotionCode").alias("_code"), "PromotionID", "DiscountType", "DiscountValue",
        "MinimumOrderAmount", "MaximumDiscount", "UsageLimit", "UsedCount",
    )
    code = F.when(~V.blank("PromotionCode"), F.upper("PromotionCode"))
    no_code = F.concat(F.lit("\0"), F.col("OrderID").cast("string"))
    judged = lookup(requests.withColumn("_code", code), terms, "_code", no_code)
    earlier = t.promotion_usage.select(
        "PromotionID", "CustomerID", F.lit(True).alias("_used")
    ).distinct()
    asked = judged.filter("PromotionID IS NOT NULL")
    elsewhere = failing_targets(t, asked, lines).withColumn("_aim", F.lit(True))
    no_promotion = -1 - F.col("OrderID")
    judged = lookup(judged, earlier, "PromotionID", no_promotion, "CustomerID").join(
        elsewhere, "OrderID", "left"
    )
    reason = V.first_failure([
        (F.col("PromotionID").isNull(), "unknown_or_inactive"),
        (F.col("SubTotal") < F.col("MinimumOrderAmount"), "below_minimum"),
        (F.col("_used"), "already_used"),
        (F.col("_aim"), "not_targeted"),
    ])
    return judged.withColumn("PromotionReason", reason).drop("_code", "_used", "_aim")


def raise_use_counts(promotions: DataFrame, used: DataFrame) -> DataFrame:
    counts = used.groupBy("PromotionID").agg(F.count("*").alias("_more"))
    raised = V.or_zero(F.col("UsedCount")) + V.or_zero(F.col("_more"))
    joined = promotions.join(counts, "PromotionID", "left")
    return joined.withColumn("UsedCount", raised.cast("int")).select(*promotions.columns)


def usage_rollup(t: Tables, accepted: DataFrame, used_at: Column) -> tuple[DataFrame, DataFrame]:
    """Promotions with raised use counts, and the usage rows of accepted orders.

    ``accepted`` carries OrderID, CustomerID, PromotionID and DiscountAmount.
    """
    used = accepted.filter("PromotionID IS NOT NULL")
    rows = used.select(
        F.col("OrderID").alias("UsageID"), "PromotionID", "OrderID", "CustomerID",
        "DiscountAmount", used_at.alias("UsedAt"),
    )
    return raise_use_counts(t.promotions, used), rows
