"""Jobs that turn the stored tables and a batch of changes into the next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.values import or_zero
from ledgerlane.operators.relational import lacking_key, latest_per_key
from ledgerlane.sources.tables import Tables


def upsert(
    base: DataFrame, changes: DataFrame, key: str, columns: list[str], arrival: list[str],
    defaults: dict[str, Column] | None = None,
) -> DataFrame:
    """Overwrite ``columns`` with the last change per key; unknown keys become rows.

    A null in a change is a value like any other.  ``defaults`` fill the
    remaining columns of new rows.
    """
    newest = latest_per_key(changes, [key], *arrival).select(
        key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_changed")
    )
    marked = base.withColumn("_stored", F.lit(True))
    joined = marked.join(newest, key, "full_outer")

    def column(name: str) -> Column:
        if name == key:
            return F.col(key)
        if name in columns:
            kind = base.schema[name].dataType
            return F.when(F.col("_changed"), F.col(f"_{name}").cast(kind)).otherwise(F.col(name)).alias(name)
        if defaults and name in defaults:
            kind = base.schema[name].dataType
            return F.when(F.col("_stored"), F.col(name)).otherwise(defaults[name].cast(kind)).alias(name)
        return F.col(name)

    return joined.select(*(column(c) for c in base.columns))


def book_changes(changes: DataFrame) -> DataFrame:
    """Fill in quantities: what came in defaults to the stock given, what left to none."""
    taken_in = F.coalesce("InputQuantity", F.col("Stock").cast("long"))
    given_out = F.coalesce("OutputQuantity", F.lit(0).cast("long"))
    return changes.withColumns({
        "InputQuantity": taken_in, "OutputQuantity": given_out,
        "Stock": (taken_in - given_out).cast("int"),
    })


BOOK_COLUMNS = ["Title", "Author", "Genre", "Price", "Stock", "InputQuantity", "OutputQuantity", "SupplierID"]
CUSTOMER_COLUMNS = ["Name", "Email", "Phone"]
SUPPLIER_COLUMNS = ["Name", "Address", "Phone"]
PROMOTION_COLUMNS = [
    "PromotionCode", "PromotionName", "Description", "DiscountType", "DiscountValue",
    "MinimumOrderAmount", "MaximumDiscount", "StartDate", "EndDate", "IsActive", "UsageLimit",
    "UpdatedAt",
]
ORDER_COLUMNS = ["CustomerID", "OrderDate", "TotalAmount"]


def upsert_books(t: Tables, changes: DataFrame, *arrival: str) -> DataFrame:
    return upsert(t.books, book_changes(changes), "BookID", BOOK_COLUMNS, list(arrival))


def upsert_customers(t: Tables, changes: DataFrame, *arrival: str) -> DataFrame:
    return upsert(t.customers, changes, "CustomerID", CUSTOMER_COLUMNS, list(arrival))


def upsert_suppliers(t: Tables, changes: DataFrame, *arrival: str) -> DataFrame:
    return upsert(t.suppliers, changes, "SupplierID", SUPPLIER_COLUMNS, list(arrival))


def upsert_promotions(t: Tables, changes: DataFrame, *arrival: str) -> DataFrame:
    """Use counts and creation times are not the caller's to change."""
    defaults = {"UsedCount": F.lit(0), "CreatedAt": F.col("_UpdatedAt")}
    return upsert(t.promotions, changes, "PromotionID", PROMOTION_COLUMNS, list(arrival), defaults)


def update_orders(t: Tables, changes: DataFrame, *arrival: str) -> DataFrame:
    """Overwrite customer, date and total of known orders; unknown ids change nothing."""
    newest = latest_per_key(changes, ["OrderID"], *arrival).select(
        "OrderID", *(F.col(c).alias(f"_{c}") for c in ORDER_COLUMNS), F.lit(True).alias("_changed")
    )
    joined = t.orders.join(newest, "OrderID", "left")
    kinds = t.orders.schema
    updated = joined.withColumns({
        c: F.when(F.col("_changed"), F.col(f"_{c}").cast(kinds[c].dataType)).otherwise(F.col(c))
        for c in ORDER_COLUMNS
    })
    return updated.select(*t.orders.columns)


def backfill_orders(t: Tables, method: int = 1) -> DataFrame:
    """Orders from before payments were kept count as paid in cash on their day."""
    old = F.col("PaymentMethodID").isNull()

    def fill(column: str, value: Column) -> Column:
        return F.when(old, value).otherwise(F.col(column))

    return t.orders.withColumns({
        "SubTotal": fill("SubTotal", F.col("TotalAmount")),
        "PaymentMethodID": fill("PaymentMethodID", F.lit(method)),
        "PaymentStatus": fill("PaymentStatus", F.lit("paid")),
        "PaymentDate": fill("PaymentDate", F.col("OrderDate").cast("timestamp")),
    })


def replace_targets(targets: DataFrame, changes: DataFrame) -> DataFrame:
    """Each changed promotion loses its targets and gets the new one, none for ``all``."""
    kept = lacking_key(targets, changes, "PromotionID")
    added = changes.filter(F.col("TargetType") != "all").select(*targets.columns)
    return kept.unionByName(added)


def fold_payments(events: DataFrame) -> DataFrame:
    """Fold payment events (EventID, OrderID, At, Status, PaymentMethodID, TransactionID).

    The last event gives status and transaction, the last paid one the payment
    date, the last one naming a method the method.  All come out of one
    aggregate that shrinks each order to a row per task before the shuffle.
    """
    turn = F.struct("At", "EventID")
    return events.groupBy("OrderID").agg(
        F.max_by(F.struct("Status", "TransactionID"), turn).alias("_last"),
        F.max(F.when(F.col("Status") == "paid", F.col("At"))).alias("_paid"),
        F.max_by(
            "PaymentMethodID", F.when(F.col("PaymentMethodID").isNotNull(), turn)
        ).alias("_method"),
    )


def with_payments(orders: DataFrame, folds: DataFrame) -> DataFrame:
    joined = orders.join(folds, "OrderID", "left")
    touched = F.col("_last").isNotNull()
    return joined.withColumns({
        "PaymentStatus": F.when(touched, F.col("_last.Status")).otherwise(F.col("PaymentStatus")),
        "TransactionID": F.when(touched, F.col("_last.TransactionID")).otherwise(F.col("TransactionID")),
        "PaymentDate": F.coalesce("_paid", "PaymentDate"),
        "PaymentMethodID": F.coalesce("_method", "PaymentMethodID"),
    }).select(*orders.columns)


def apply_payments(orders: DataFrame, events: DataFrame) -> DataFrame:
    return with_payments(orders, fold_payments(events))


def _sold(lines: DataFrame, name: str) -> DataFrame:
    return lines.groupBy("BookID").agg(F.sum("Quantity").alias(name))


def stock_ledger(t: Tables) -> DataFrame:
    """Stock as recorded, and as it follows from what came in and was sold."""
    joined = t.books.select("BookID", "Stock", "InputQuantity", "OutputQuantity").join(
        _sold(t.order_details, "Sold"), "BookID", "left"
    ).withColumn("Sold", or_zero(F.col("Sold")))
    expected = or_zero(F.col("InputQuantity")) - F.col("Sold")
    return joined.withColumns(
        {"LedgerStock": expected, "Drift": F.col("Stock") - expected}
    )


def stock_drift(t: Tables) -> DataFrame:
    return stock_ledger(t).filter("Drift <> 0")


def reconcile_books(t: Tables) -> DataFrame:
    """Books whose recorded stock is right and whose quantities are made to explain it."""
    joined = t.books.join(_sold(t.order_details, "_sold"), "BookID", "left")
    sold = or_zero(F.col("_sold"))
    return joined.withColumns({
        "OutputQuantity": sold, "InputQuantity": F.col("Stock") + sold
    }).select(*t.books.columns)


def backfill_quantities(books: DataFrame) -> DataFrame:
    """Books from before quantities were kept: all stock came in, nothing left."""
    old = F.col("InputQuantity").isNull() | F.col("OutputQuantity").isNull()
    return books.withColumns({
        "InputQuantity": F.when(old, F.col("Stock").cast("long")).otherwise(F.col("InputQuantity")),
        "OutputQuantity": F.when(old, F.lit(0).cast("long")).otherwise(F.col("OutputQuantity")),
    })


def adjust_stock(t: Tables, deltas: DataFrame) -> DataFrame:
    """Add the sum of the deltas (BookID, Delta) to each book's stock."""
    summed = deltas.groupBy("BookID").agg(F.sum("Delta").alias("_delta"))
    joined = t.books.join(summed, "BookID", "left")
    stock = (F.col("Stock") + or_zero(F.col("_delta"))).cast("int")
    return joined.withColumn("Stock", stock).select(*t.books.columns)


def move_stock(books: DataFrame, moved: DataFrame, sign: int) -> DataFrame:
    """Book quantities (BookID, Quantity) out (+1) or back (-1); stock follows the ledger."""
    joined = books.join(_sold(moved, "_moved"), "BookID", "left")
    output = F.col("OutputQuantity") + sign * F.col("_moved")
    touched = F.col("_moved").isNotNull()
    return joined.withColumns({
        "OutputQuantity": F.when(touched, output).otherwise(F.col("OutputQuantity")),
        "Stock": F.when(touched, (F.col("InputQuantity") - output).cast("int")).otherwise(F.col("Stock")),
    }).select(*books.columns)


def cancel_outcomes(t: Tables, ids: DataFrame) -> DataFrame:
    """What happens to each order id to cancel; an order behind a promotion use stays."""
    known = t.orders.select("OrderID").withColumn("_known", F.lit(True))
    used = t.promotion_usage.select("OrderID").distinct().withColumn("_used", F.lit(True))
    joined = ids.select("OrderID").distinct().join(known, "OrderID", "left").join(
        used, "OrderID", "left"
    )
    outcome = F.when(F.col("_known").isNull(), "unknown").when(
        F.col("_used"), "has_promotion_usage").otherwise("cancelled")
    return joined.select("OrderID", outcome.alias("Outcome"))


def cancel_orders(t: Tables, ids: DataFrame) -> Tables:
    """The tables without the cancelled orders, their quantities back in stock."""
    gone = cancel_outcomes(t, ids).filter("Outcome = 'cancelled'")
    returned = t.order_details.join(gone.select("OrderID"), "OrderID", "left_semi")
    return t.replace(
        orders=lacking_key(t.orders, gone, "OrderID"),
        order_details=lacking_key(t.order_details, gone, "OrderID"),
        books=move_stock(t.books, returned, -1),
    )
