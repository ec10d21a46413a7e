"""Checks on incoming rows.  Every frame comes back with a ``Reason``, null when valid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane import schema as S
from ledgerlane.functions.values import blank, first_failure, numeric
from ledgerlane.operators.relational import lacking_key, lookup

_LINE_REASONS = ("item_without_book", "bad_item_quantity", "bad_item_price")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter("Reason IS NULL").drop("Reason")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.filter("Reason IS NOT NULL")


def _not_positive(column: str):
    return numeric(column).isNull() | (numeric(column) <= 0)


def _negative_if_given(column: str):
    return F.col(column).isNotNull() & (numeric(column).isNull() | (numeric(column) < 0))


def validate_books(requests: DataFrame) -> DataFrame:
    return requests.withColumn("Reason", first_failure([
        (blank("Title"), "title_missing"),
        (blank("Author"), "author_missing"),
        (blank("Genre"), "genre_missing"),
        (_not_positive("Price"), "bad_price"),
        (_negative_if_given("InputQuantity"), "bad_input_quantity"),
        (_negative_if_given("OutputQuantity"), "bad_output_quantity"),
        (_negative_if_given("Stock"), "bad_stock"),
        (blank("SupplierID"), "supplier_missing"),
    ]))


def _phone_checks():
    return [
        (blank("Phone"), "phone_missing"),
        (~F.col("Phone").rlike(S.PHONE_PATTERN), "bad_phone"),
    ]


def validate_customers(requests: DataFrame) -> DataFrame:
    """The e-mail test is a plain shape test with a length limit."""
    email = F.col("Email")
    shaped = email.rlike(S.EMAIL_PATTERN) & (F.length(email) <= S.EMAIL_LENGTH)
    return requests.withColumn("Reason", first_failure([
        (blank("Name"), "name_missing"),
        (blank("Email"), "email_missing"),
        (~shaped, "bad_email"),
        *_phone_checks(),
    ]))


def validate_suppliers(requests: DataFrame) -> DataFrame:
    return requests.withColumn("Reason", first_failure([
        (blank("Name"), "name_missing"),
        (blank("Address"), "address_missing"),
        *_phone_checks(),
    ]))


def validate_promotions(requests: DataFrame) -> DataFrame:
    """Field checks; whether the code is free is asked by ``unique_conflicts``."""
    kind, value = F.col("DiscountType"), numeric("DiscountValue")
    start, end = (F.try_to_date(F.col(c), "yyyy-MM-dd") for c in ("StartDate", "EndDate"))
    return requests.withColumn("Reason", first_failure([
        (blank("PromotionCode"), "code_missing"),
        (blank("PromotionName"), "name_missing"),
        (blank("DiscountType") | ~kind.isin(*S.DISCOUNT_TYPES), "bad_type"),
        (_not_positive("DiscountValue"), "bad_value"),
        ((kind == "percentage") & (value > 100), "percentage_above_100"),
        (blank("StartDate") | blank("EndDate"), "dates_missing"),
        (~F.col("StartDate").rlike(S.DATE_PATTERN), "bad_start_format"),
        (~F.col("EndDate").rlike(S.DATE_PATTERN), "bad_end_format"),
        (start.isNull(), "bad_start"),
        (end.isNull(), "bad_end"),
        (end <= start, "end_not_after_start"),
    ]))


def explode_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested order requests as headers and lines, the lines with their position."""
    lines = requests.select("OrderID", F.posexplode("items").alias("Position", "item"))
    return requests.drop("items"), lines.select("OrderID", "Position", "item.*")


def _line_fault(book, quantity, price):
    """1, 2 or 3 for the first failing check of a line, else null."""
    def bad(column):
        return numeric(column).isNull() | (numeric(column) <= 0)
    return F.when(blank(book), 1).when(bad(quantity), 2).when(bad(price), 3)


def _reason_of(fault):
    return first_failure((fault == code, r) for code, r in enumerate(_LINE_REASONS, 1))


def _header_checks(has_items):
    return [
        (blank("CustomerID"), "customer_missing"),
        (blank("OrderDate"), "date_missing"),
        (_not_positive("TotalAmount"), "bad_total"),
        (~has_items, "no_items"),
    ]


def _line_rank():
    """Position and fault as one number: the earliest fault is a plain minimum."""
    fault = _line_fault(F.col("BookID"), F.col("Quantity"), F.col("Price"))
    return F.col("Position") * 4 + fault


def judge_orders(headers: DataFrame, facts: DataFrame) -> DataFrame:
    """Judge headers by their own fields and by ``FirstFault`` of their lines."""
    joined = headers.join(facts.withColumn("_has", F.lit(True)), "OrderID", "left")
    judged = joined.withColumn("Reason", F.coalesce(
        first_failure(_header_checks(F.col("_has").isNotNull())),
        _reason_of(F.col("FirstFault") % 4),
    ))
    return judged.drop("FirstFault", "_has")


def validate_orders(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Judge orders by header and lines; the earliest failing line gives the reason."""
    facts = lines.groupBy("OrderID").agg(F.min(_line_rank()).alias("FirstFault"))
    return judge_orders(headers, facts)


def line_facts(lines: DataFrame) -> DataFrame:
    """Per order, in one pass: the first fault and the subtotal of what counts."""
    counted = ~blank("BookID") & (F.col("Quantity") > 0)
    amount = F.sum(F.when(counted, F.col("Quantity") * F.col("Price")))
    return lines.groupBy("OrderID").agg(
        F.min(_line_rank()).alias("FirstFault"),
        F.coalesce(amount, F.lit(0)).cast(S.MONEY).alias("SubTotal"),
    )


def validate_nested_orders(requests: DataFrame) -> DataFrame:
    """The same judgement row by row on nested requests, without a shuffle."""
    items = F.col("items")
    faults = F.filter(
        F.transform(items, lambda i: _line_fault(i.BookID, i.Quantity, i.Price)),
        lambda f: f.isNotNull(),
    )
    has_items = F.coalesce(F.size(items) > 0, F.lit(False))
    return requests.withColumn("Reason", F.coalesce(
        first_failure(_header_checks(has_items)),
        _reason_of(F.get(faults, 0)),
    ))


def unique_conflicts(
    batch: DataFrame, existing: DataFrame, key: str, value: str, arrival: str
) -> DataFrame:
    """Mark batch rows whose ``value`` another stored row or an earlier batch row holds.

    A row that updates its own record may keep its value.  Letter case does
    not matter.  Holders are reduced to one row per value before the join.
    """
    stored = existing.groupBy(F.lower(value).alias("_value")).agg(
        F.min(key).alias("_low"), F.max(key).alias("_high")
    )
    named = batch.withColumn("_value", F.lower(value))
    first = named.groupBy("_value").agg(F.min(arrival).alias("_first"))
    own = F.coalesce(F.col(key), F.lit(-1))
    no_value = F.concat(F.lit("\0"), F.col(arrival).cast("string"))
    joined = lookup(lookup(named, stored, "_value", no_value), first, "_value", no_value)
    reason = first_failure([
        ((F.col("_low") != own) | (F.col("_high") != own), f"{value}_taken"),
        (F.col(arrival) > F.col("_first"), f"{value}_repeated"),
    ])
    return joined.withColumn("Reason", reason).select(*batch.columns, "Reason")


def delete_outcomes(
    ids: DataFrame, base: DataFrame, references: DataFrame, key: str
) -> DataFrame:
    """What happens to each id to delete: kept while referenced, unknown, or deleted."""
    used = references.select(key).distinct().withColumn("_used", F.lit(True))
    known = base.select(key).withColumn("_known", F.lit(True))
    joined = ids.select(key).distinct().join(used, key, "left").join(known, key, "left")
    outcome = F.when(F.col("_used"), "in_use").when(F.col("_known"), "deleted").otherwise("unknown")
    return joined.select(key, outcome.alias("Outcome"))


def delete_rows(base: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    return lacking_key(base, outcomes.filter("Outcome = 'deleted'"), key)
