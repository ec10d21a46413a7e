"""

Queries run over the whole star-schema tables of a folder.  Results are given
plain types (see ``comparable``) so that they can be compared with the SQL of
another engine value by value.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.plans import catalog, constraints, dashboard, orders, ordering, parties, payments
from ledgerlane.plans import profile, promotions, revenue, rollup, state, validation
from ledgerlane.schema import ORDER_REQUEST
from ledgerlane.session import Scratch
from ledgerlane.sources import batches as B
from ledgerlane.sources import requests, star
from ledgerlane.sources.tables import Tables
from ledgerlane.streaming import orders as intake
from ledgerlane.streaming import sales
from ledgerlane.streaming.replay import replay
from oracles.sql import oracle_sql as _oracle_sql

try:
    from ledgerlane.llm import queries as text_queries
except ModuleNotFoundError as missing:
    # Only the absence of the package itself, or of the pipeline that goes with it, is accepted.
    # Neither is on hand where the tokenizers' files aren't.
    if missing.name not in ("ledgerlane.llm", "ledgerlane.llm.queries", "corpus_pipeline", "public_tokenizers"):
        raise
    text_queries = None

SALES_AS_OF = dt.datetime(2001, 8, 1, 12)
PROMOTION_AS_OF = dt.datetime(2024, 6, 15, 12)
RANGE = (dt.date(1998, 1, 1), dt.date(1998, 12, 31))

#: Whole-number columns that may be null are compared as text.
NULLABLE_NUMBERS = {
    "SupplierID", "PaymentMethodID", "PromotionID", "UsageLimit", "TargetID_Value", "CustomerID",
    "FirstKey", "LastKey",
}


def comparable(df: DataFrame) -> DataFrame:
    """Numbers as long or double, dates and times as text."""
    def plain(field: T.StructField):
        column = F.col(field.name)
        if field.name in NULLABLE_NUMBERS:
            return column.cast("long").cast("string").alias(field.name)
        if isinstance(field.dataType, (T.DecimalType, T.FloatType, T.DoubleType)):
            return column.cast("double").alias(field.name)
        if isinstance(field.dataType, T.IntegralType):
            return column.cast("long").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(column, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        return column

    return df.select(*(plain(f) for f in df.schema.fields))


def _tables_query(build: Callable[[Tables], DataFrame]):
    return lambda s, d: build(star.star_tables(s, d))


def _sales(build):
    return _tables_query(lambda t: build(t, SALES_AS_OF))


def _reasons(judged: DataFrame, key: str) -> DataFrame:
    return judged.select(key, "Reason")


def _deletes(table: str, key: str, name: str, base: str, references: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        t = star.star_tables(spark, root)
        ids = B.twice_the_keys(spark, root, table, key, name)
        return validation.delete_outcomes(ids, getattr(t, base), getattr(t, references), name)
    return run


def _unique(requests, base: str, key: str, value: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        stored = getattr(star.star_tables(spark, root), base)
        judged = validation.unique_conflicts(requests(spark, root), stored, key, value, "RequestID")
        return _reasons(judged, "RequestID")
    return run


def _reconciled(t: Tables) -> Tables:
    return t.replace(books=state.reconcile_books(t))


def _cancelled(pick: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        t = _reconciled(star.star_tables(spark, root))
        return getattr(state.cancel_orders(t, B.cancellations(spark, root)), pick)
    return run


def _taken(pick: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        t = star.star_tables(spark, root)
        headers, lines = B.order_requests(spark, root)
        scratch = Scratch(spark, "take-orders")
        taken = ordering.take_orders(t, headers, lines, PROMOTION_AS_OF, scratch)
        return getattr(taken, pick)
    return run


def _take_decisions(spark: SparkSession, root: str) -> DataFrame:
    return _taken("decisions")(spark, root).select("OrderID", "Accepted", "Reason")


def _promotion_checks(spark: SparkSession, root: str) -> DataFrame:
    requests, lines = B.promotion_uses(spark, root)
    t = star.star_tables(spark, root)
    return promotions.validate_promotions(t, requests, lines, PROMOTION_AS_OF)


def _promotion_targets(spark: SparkSession, root: str) -> DataFrame:
    requests, lines = B.promotion_uses(spark, root)
    t = star.star_tables(spark, root)
    asked = requests.join(t.promotions.select(
        F.upper("PromotionCode").alias("PromotionCode"), "PromotionID"
    ), "PromotionCode")
    return promotions.failing_targets(t, asked, lines)


def _discounts(spark: SparkSession, root: str) -> DataFrame:
    terms = star.star_tables(spark, root).promotions.select(
        "PromotionID", "DiscountType", "DiscountValue", "MaximumDiscount"
    )
    used = star.orders(spark, root).join(terms, "PromotionID").select(
        "OrderID", "SubTotal", "DiscountType", "DiscountValue", "MaximumDiscount"
    )
    return promotions.with_discount(used).select("OrderID", "SubTotal", "DiscountAmount")


def _use_counts(spark: SparkSession, root: str) -> DataFrame:
    t = star.star_tables(spark, root)
    return promotions.usage_rollup(t, t.orders, F.lit(PROMOTION_AS_OF))[0].select(
        "PromotionID", "UsedCount")


def _use_rows(spark: SparkSession, root: str) -> DataFrame:
    t = star.star_tables(spark, root)
    return promotions.usage_rollup(t, t.orders, F.lit(PROMOTION_AS_OF))[1]


def _priced(spark: SparkSession, root: str) -> DataFrame:
    t = star.star_tables(spark, root)
    return ordering.price_orders(t, *B.order_requests(spark, root), PROMOTION_AS_OF)


def _method_checks(spark: SparkSession, root: str) -> DataFrame:
    headers, _ = B.order_requests(spark, root)
    t = star.star_tables(spark, root)
    return payments.valid_methods(t, headers.select("OrderID", "PaymentMethodID"))


def _codes_asked(spark: SparkSession, root: str) -> DataFrame:
    codes = B.order_requests(spark, root)[0].select("PromotionCode")
    return promotions.promotions_by_code(star.star_tables(spark, root), codes, PROMOTION_AS_OF)


def _promotion_updates(spark: SparkSession, root: str) -> DataFrame:
    t = star.star_tables(spark, root)
    return state.upsert_promotions(t, B.promotion_changes(spark, root), "-UpdatedAt")


def _book_updates(spark: SparkSession, root: str) -> DataFrame:
    t = star.star_tables(spark, root)
    return state.upsert_books(t, B.book_changes(spark, root), *B.LINE_ORDER)


def _customer_updates(spark: SparkSession, root: str) -> DataFrame:
    t = star.star_tables(spark, root)
    order = ("-o_orderdate", "-o_orderkey")
    return state.upsert_customers(t, B.customer_changes(spark, root), *order)


def _supplier_updates(spark: SparkSession, root: str) -> DataFrame:
    t = star.star_tables(spark, root)
    order = ("-" + c for c in (
        "l_shipdate", "l_orderkey", "l_extendedprice", "l_quantity", "l_partkey", "l_linestatus",
        "l_returnflag"))
    return state.upsert_suppliers(t, B.supplier_changes(spark, root), *order)


def _order_updates(spark: SparkSession, root: str) -> DataFrame:
    t = star.star_tables(spark, root)
    order = ("-" + c for c in ("l_shipdate", "l_extendedprice", "l_suppkey"))
    return state.update_orders(t, B.order_changes(spark, root), *order)


def _payment_updates(spark: SparkSession, root: str) -> DataFrame:
    t = star.star_tables(spark, root)
    events = B.payment_events(star.source(spark, root, "events"))
    return state.apply_payments(t.orders, events)


def _stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.readStream.schema(star.SOURCE[name]).parquet(f"{root}/{name}*.parquet")


def _streamed_sales(spark: SparkSession, root: str) -> DataFrame:
    """The trends after the stream has caught up with all stored events."""
    scratch = Scratch(spark, "stream-sales")
    log = intake.BatchLog(spark, scratch.path)
    trends = sales.daily_sales(B.purchases(_stream(spark, root, "events")))
    trends = trends.drop("DailyCustomers")
    query = intake.run(
        trends, lambda df, n: log.write("trends", n, df), f"{scratch.path}/progress", "complete"
    )
    query.awaitTermination()
    return log.read_one("trends", trends.schema, query.lastProgress["batchId"])


def _streamed_payments(spark: SparkSession, root: str) -> DataFrame:
    """The orders after the stream has caught up with all stored payment events."""
    scratch = Scratch(spark, "stream-payments")
    log = intake.BatchLog(spark, scratch.path)
    folds = intake.folded_payments(B.payment_events(_stream(spark, root, "events")))
    query = intake.run(folds, intake.payment_intake(log), f"{scratch.path}/progress", "update")
    query.awaitTermination()
    orders_now = star.orders(spark, root)
    last = query.lastProgress["batchId"]
    return intake.orders_with_payments(log, orders_now, folds.schema, last)


def _streamed_checks(spark: SparkSession, root: str) -> DataFrame:
    scratch = Scratch(spark, "stream-checks")
    log = intake.BatchLog(spark, scratch.path)
    drafts = B.draft_headers(B.request_headers(_stream(spark, root, "orders")))
    lines = B.draft_lines(B.request_lines(spark, root))
    step = intake.order_checks(log, intake.with_stored_lines(lines))
    query = intake.run(drafts, step, f"{scratch.path}/progress")
    query.awaitTermination()
    schema = validation.validate_orders(*B.draft_orders(spark, root)).schema
    return log.read("judged", schema, -1, query.lastProgress["batchId"] + 1).select("OrderID", "Reason")


def _streamed_intake(spark: SparkSession, root: str) -> DataFrame:
    scratch = Scratch(spark, "stream-intake")
    log = intake.BatchLog(spark, scratch.path)
    headers = B.request_headers(_stream(spark, root, "orders"))
    step = intake.order_intake(
        log, star.star_tables(spark, root), PROMOTION_AS_OF,
        split=intake.with_stored_lines(B.request_lines(spark, root)),
    )
    query = intake.run(headers, step, f"{scratch.path}/progress")
    query.awaitTermination()
    decided = T.StructType([
        T.StructField("OrderID", T.LongType()), T.StructField("Accepted", T.BooleanType()),
        T.StructField("Reason", T.StringType()),
    ])
    return log.read("decisions", decided, -1, query.lastProgress["batchId"] + 1).drop("batch")


def _purchases_replayed(spark: SparkSession, root: str, build, scratch: Scratch) -> DataFrame:
    """What a stream over the purchases logs in append mode, over ten batches and a restart."""
    log = intake.BatchLog(spark, scratch.path)
    events = star.source(spark, root, "events").withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    schemas = []

    def start(stream: DataFrame, progress: str):
        made = build(B.purchases(stream))
        schemas.append(made.schema)
        return intake.run(made, lambda df, n: log.write("made", n, df), progress)

    last = replay(spark, events, "at", scratch.path, start)
    return log.read("made", schemas[0], -1, last + 1).drop("batch")


def _replayed_sales(spark: SparkSession, root: str) -> DataFrame:
    """The days that the watermark has closed."""
    days = _purchases_replayed(spark, root, sales.daily_sales, Scratch(spark, "replay-sales"))
    return days.drop("DailyCustomers")


def _replayed_buyers(spark: SparkSession, root: str) -> DataFrame:
    pairs = _purchases_replayed(spark, root, sales.daily_buyers, Scratch(spark, "replay-buyers"))
    return pairs.groupBy(F.date_format("Day", "yyyy-MM-dd").alias("Date")).agg(F.count("*").alias("DailyCustomers"))


def _replayed_payments(spark: SparkSession, root: str) -> DataFrame:
    scratch = Scratch(spark, "replay-payments")
    log = intake.BatchLog(spark, scratch.path)
    events = star.source(spark, root, "events")
    folds = intake.folded_payments(B.payment_events(events))
    start = lambda stream, progress: intake.run(
        intake.folded_payments(B.payment_events(stream)), intake.payment_intake(log), progress, "update")
    last = replay(spark, events, "event_id", scratch.path, start)
    return intake.orders_with_payments(log, star.orders(spark, root), folds.schema, last)


def _replayed_checks(spark: SparkSession, root: str) -> DataFrame:
    scratch = Scratch(spark, "replay-checks")
    log = intake.BatchLog(spark, scratch.path)
    drafts, lines = B.draft_orders(spark, root)
    step = intake.order_checks(log, intake.with_stored_lines(lines))
    last = replay(spark, drafts, "OrderID", scratch.path, lambda stream, progress: intake.run(stream, step, progress))
    schema = validation.validate_orders(drafts, lines).schema
    return log.read("judged", schema, -1, last + 1).select("OrderID", "Reason")


def _replayed_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """First deliveries by order number, then the second ones, over ten batches and a restart."""
    scratch = Scratch(spark, "replay-deliveries")
    log = intake.BatchLog(spark, scratch.path)
    headers, lines = B.deliveries(spark, root)
    lines = scratch.save(lines.repartitionByRange("OrderID").sortWithinPartitions("OrderID"), "lines")
    step = intake.exact_intake(
        log, star.star_tables(spark, root), PROMOTION_AS_OF, intake.with_stored_lines(lines), snapshot_every=4)
    turn = F.col("OrderID").cast("double") + (F.col("Delivery") - 1) * 4.0 * B.FAR
    arriving = headers.withColumn("turn", turn)
    last = replay(
        spark, arriving, "turn", scratch.path, lambda stream, progress: intake.run(stream.drop("turn"), step, progress))
    return log.read("decisions", intake.DELIVERED, -1, last + 1).drop("batch")


def _referring(batch, references, *row: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        judged = constraints.with_references(
            star.star_tables(spark, root), batch(spark, root), references, Scratch(spark, "references"), row)
        return judged.select(*row, "Reason")
    return run


def _served_once(spark: SparkSession, root: str) -> DataFrame:
    t = star.star_tables(spark, root)
    scratch = Scratch(spark, "take-once")
    return constraints.take_once(t, *B.deliveries(spark, root), PROMOTION_AS_OF, scratch)[0]


def _texts_read(spark: SparkSession, root: str) -> DataFrame:
    """Requests in JSON: whether each is taken, and what it asks for."""
    judged = requests.read_texts(
        B.request_texts(star.source(spark, root, "events")), "Text", ORDER_REQUEST, ("OrderID", "CustomerID", "items"))
    items = F.col("Parsed.items")
    total = F.aggregate(items, F.lit(0), lambda s, i: s + i["Quantity"])
    return judged.select(
        "event_id", "Reason", F.coalesce(F.size(items), F.lit(0)).alias("Lines"), F.coalesce(total, F.lit(0)).alias("Quantity"))


def _rolled(report):
    """A report from the stored rollup."""
    return _tables_query(lambda t: report(revenue.stored_rollup(t)))


def _refreshed(spark: SparkSession, root: str) -> DataFrame:
    """The days after pending orders came in late: a rollup without them, refreshed where they fall."""
    orders_now = star.orders(spark, root).select("OrderDate", "CustomerID", "TotalAmount", "PaymentStatus")
    path = f"{Scratch(spark, 'rollup-refresh').path}/days"
    late = orders_now.filter("PaymentStatus = 'pending'")
    rollup.write_rollup(rollup.sales_rollup(orders_now.filter("PaymentStatus <> 'pending'")), path)
    rollup.refresh(path, orders_now, late)
    return rollup.daily(rollup.read_rollup(spark, path, rollup.sales_rollup(orders_now)))


def _order_drafts(spark: SparkSession, root: str) -> DataFrame:
    return _reasons(validation.validate_orders(*B.draft_orders(spark, root)), "OrderID")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # dashboard
    "dash_overview": _sales(dashboard.overview),
    "dash_monthly": _sales(dashboard.monthly),
    "dash_top_books": _tables_query(dashboard.top_books),
    "dash_top_customers": _tables_query(dashboard.top_customers),
    "dash_low_stock": _tables_query(dashboard.low_stock),
    "dash_genre": _tables_query(dashboard.genres),
    "dash_genre_exact": _tables_query(dashboard.genres_exact),
    "dash_supplier": _tables_query(dashboard.suppliers),
    "dash_supplier_exact": _tables_query(dashboard.suppliers_exact),
    "dash_inventory": _tables_query(dashboard.inventory),
    "dash_customer_growth": _sales(dashboard.customer_growth),
    "dash_customer_growth_exact": _sales(dashboard.customer_growth_exact),
    "dash_sales_trends": _sales(dashboard.sales_trends),
    "dash_order_recency": _sales(dashboard.order_recency),
    "dash_new_books": _tables_query(dashboard.new_books),
    "dash_recent_orders": _tables_query(dashboard.recent_orders),
    "dash_sales_chart_month": _sales(dashboard.sales_chart),
    "dash_sales_chart_day": _tables_query(lambda t: dashboard.sales_chart(t, SALES_AS_OF, "day")),
    "dash_all": _sales(revenue.dashboard_document),
    "rev_weekly": _sales(revenue.weekly),
    "rev_monthly": _sales(revenue.monthly),
    "rev_yearly": _tables_query(revenue.yearly),
    "rev_summary": _sales(revenue.summary),
    "rev_bundle": _sales(lambda t, now: revenue.report_document(revenue.bundle(t, now))),
    # period reports merged from the rollup
    "rollup_refresh": _refreshed,
    "rollup_monthly": _rolled(lambda r: rollup.monthly(r, SALES_AS_OF)),
    "rollup_weekly": _rolled(lambda r: rollup.weekly(r, SALES_AS_OF)),
    "rollup_yearly": _rolled(rollup.yearly),
    "rollup_summary": _rolled(lambda r: rollup.summary(r, SALES_AS_OF)),
    "rollup_customer_growth": _rolled(lambda r: rollup.customer_growth(r, SALES_AS_OF)),
    "rollup_sales_trends": _rolled(lambda r: rollup.sales_trends(r, SALES_AS_OF)),
    "rollup_sales_chart_day": _rolled(lambda r: rollup.sales_chart(r, SALES_AS_OF, "day")),
    "rollup_order_recency": _rolled(lambda r: rollup.order_recency(r, SALES_AS_OF)),
    "rollup_order_totals": _rolled(lambda r: rollup.order_totals(r, SALES_AS_OF)),
    # books, customers, suppliers
    "book_list": _tables_query(catalog.book_list),
    "book_lookup": lambda s, d: catalog.book_lookup(
        star.star_tables(s, d), star.order_details(s, d)),
    "book_search": _tables_query(lambda t: catalog.book_search(t, "RED%ring")),
    "book_low_stock": _tables_query(catalog.book_low_stock),
    "book_typeahead": _tables_query(lambda t: catalog.book_typeahead(t, "Widget")),
    "customer_list": _tables_query(parties.customer_list),
    "customer_lookup": lambda s, d: parties.customer_lookup(
        star.star_tables(s, d), star.orders(s, d)),
    "customer_search": _tables_query(lambda t: parties.customer_search(t, "building")),
    "customer_orders": lambda s, d: parties.customer_orders(
        star.star_tables(s, d), star.customers(s, d)),
    "customer_top": _tables_query(parties.customer_top),
    "supplier_list": _tables_query(parties.supplier_list),
    "supplier_lookup": lambda s, d: parties.supplier_lookup(
        star.star_tables(s, d), star.books(s, d)),
    "supplier_search": _tables_query(lambda t: parties.supplier_search(t, "nation 1_")),
    "supplier_books": lambda s, d: parties.supplier_books(
        star.star_tables(s, d), star.suppliers(s, d)),
    "supplier_top": _tables_query(parties.supplier_top),
    "supplier_stats": _tables_query(parties.supplier_stats),
    "supplier_stats_exact": _tables_query(parties.supplier_stats_exact),
    # orders, payments, promotions
    "order_list": _tables_query(orders.order_list),
    "order_lookup": lambda s, d: orders.order_lookup(
        star.star_tables(s, d), star.order_details(s, d)),
    "order_details": lambda s, d: orders.order_details(
        star.star_tables(s, d), star.orders(s, d)),
    "order_date_range": _tables_query(lambda t: orders.orders_between(t, *RANGE)),
    "order_stats": _tables_query(orders.order_stats),
    "pay_methods_active": lambda s, d: payments.active_methods(star.payment_methods_in_use(s, d)),
    "pay_method_valid": _method_checks,
    "pay_stats": _tables_query(payments.payment_stats),
    "pay_stats_range": _tables_query(lambda t: payments.payment_stats(t, *RANGE)),
    "pay_orders_by_status": _tables_query(lambda t: payments.orders_by_status(t, "paid")),
    "pay_usage": _tables_query(payments.method_usage),
    "promo_active": _tables_query(lambda t: promotions.active_promotions(t, PROMOTION_AS_OF)),
    "promo_by_code": _codes_asked,
    "promo_history": lambda s, d: promotions.usage_history(
        star.star_tables(s, d), star.customers(s, d)),
    "promo_new_customers": _tables_query(promotions.new_customers),
    "promo_loyal_customers": _tables_query(promotions.loyal_customers),
    "promo_list": _tables_query(promotions.promotion_list),
    "promo_search": _tables_query(lambda t: promotions.promotion_list(t, "blue")),
    # promotion rules
    "promo_validate": lambda s, d: _promotion_checks(s, d).select("OrderID", "PromotionReason"),
    "promo_targets": _promotion_targets,
    "promo_discount": _discounts,
    "promo_use_counts": _use_counts,
    "promo_use_rows": _use_rows,
    # pricing and stock rules
    "order_subtotal": _tables_query(lambda t: orders.order_subtotals(t.order_details)),
    "order_total": _tables_query(orders.order_totals),
    "order_line_totals": _tables_query(orders.line_totals),
    "stock_levels": _tables_query(catalog.stock_levels),
    "top_rank_books": _tables_query(dashboard.ranked_books),
    "top_rank_customers": _tables_query(dashboard.ranked_customers),
    "stock_shortfall": _tables_query(orders.stock_shortfall),
    "insight_summary": _sales(dashboard.insights),
    "low_stock_pct": _tables_query(dashboard.low_stock_share),
    "dash_top5_views": _sales(lambda t, now: revenue.report_document(revenue.top_views(t, now))),
    "export_report": _sales(lambda t, now: revenue.report_document(revenue.export_report(t, now))),
    "dash_all_values": _sales(lambda t, now: revenue.values_document(revenue.full_dashboard(t, now))),
    "rev_bundle_values": _sales(lambda t, now: revenue.values_document(revenue.bundle(t, now))),
    "dash_top5_values": _sales(lambda t, now: revenue.values_document(revenue.top_views(t, now))),
    "export_report_values": _sales(lambda t, now: revenue.values_document(revenue.export_report(t, now))),
    # checks on incoming rows
    "validate_books": lambda s, d: _reasons(
        validation.validate_books(B.book_requests(s, d)), "BookID"),
    "validate_customers": lambda s, d: _reasons(
        validation.validate_customers(B.customer_requests(s, d)), "RequestID"),
    "validate_suppliers": lambda s, d: _reasons(
        validation.validate_suppliers(B.supplier_requests(s, d)), "RequestID"),
    "validate_orders": _order_drafts,
    "validate_promotions": lambda s, d: _reasons(
        validation.validate_promotions(B.promotion_requests(s, d)), "RequestID"),
    "read_requests": _texts_read,
    "unique_customer_email": _unique(B.customer_requests, "customers", "CustomerID", "Email"),
    "unique_supplier_phone": _unique(B.supplier_requests, "suppliers", "SupplierID", "Phone"),
    "unique_promotion_code": _unique(
        B.promotion_requests, "promotions", "PromotionID", "PromotionCode"),
    "delete_books": _deletes("part", "p_partkey", "BookID", "books", "order_details"),
    "delete_customers": _deletes("customer", "c_custkey", "CustomerID", "customers", "orders"),
    "delete_suppliers": _deletes("supplier", "s_suppkey", "SupplierID", "suppliers", "books"),
    "delete_promotions": _deletes(
        "part", "p_partkey", "PromotionID", "promotions", "promotion_usage"),
    # references and order numbers
    "fk_orders": _referring(B.referring_orders, constraints.ORDERS, "OrderID"),
    "fk_order_details": _referring(B.referring_lines, constraints.ORDER_DETAILS, "OrderID", "Position"),
    "fk_books": _referring(star.books, constraints.BOOKS, "BookID"),
    "fk_targets": _referring(B.referring_targets, constraints.PROMOTION_TARGETS, "TargetID"),
    "fk_promotion_usage": _referring(star.promotion_usage, constraints.PROMOTION_USAGE, "UsageID"),
    "take_orders_replayed": _served_once,
    "constraint_profile": lambda spark, root: profile.constraint_profile(star.star_tables(spark, root)),
    # state after changes
    "upsert_books": _book_updates,
    "upsert_customers": _customer_updates,
    "upsert_suppliers": _supplier_updates,
    "upsert_promotions": _promotion_updates,
    "price_orders": _priced,
    "take_orders": _take_decisions,
    "take_orders_stock": _taken("books"),
    "stock_ledger": _tables_query(state.stock_ledger),
    "stock_drift": _tables_query(state.stock_drift),
    "reconcile_books": _tables_query(state.reconcile_books),
    "adjust_stock": lambda s, d: state.adjust_stock(star.star_tables(s, d), B.stock_deltas(s, d)),
    "cancel_outcomes": lambda s, d: state.cancel_outcomes(
        star.star_tables(s, d), B.cancellations(s, d)),
    "cancel_orders_left": _cancelled("orders"),
    "cancel_lines_left": _cancelled("order_details"),
    "cancel_stock": _cancelled("books"),
    "apply_payments": _payment_updates,
    "update_orders": _order_updates,
    "backfill_orders": _tables_query(state.backfill_orders),
    "replace_targets": lambda s, d: state.replace_targets(
        star.star_tables(s, d).promotion_targets, B.target_changes(s, d)),
    # streams
    "stream_sales_trends": _streamed_sales,
    "stream_payment_state": _streamed_payments,
    "stream_validate_orders": _streamed_checks,
    "stream_take_orders": _streamed_intake,
    # streams over many batches, stopped and started again
    "replay_sales_trends": _replayed_sales,
    "replay_daily_buyers": _replayed_buyers,
    "replay_payment_state": _replayed_payments,
    "replay_validate_orders": _replayed_checks,
    "replay_take_orders": _replayed_deliveries,
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: best-selling books, over the smallest data set."""
    return queries()["dash_top_books"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def plain(run):
        return lambda spark, root: comparable(run(spark, root))

    shop = {name: plain(run) for name, run in _QUERIES.items()}
    return shop | (text_queries.QUERIES if text_queries else {})


def oracle_sql() -> dict[str, str]:
    return _oracle_sql() | (text_queries.ORACLES if text_queries else {})
