import datetime as dt

from shop_frames import frame, rows
from pyspark.sql import functions as F

from ledgerlane import schema as S
from ledgerlane.plans import state


def test_upsert_takes_the_last_change_and_keeps_nulls(spark, shop):
    t = shop(customers=[{"CustomerID": 1, "Name": "A", "Email": "a", "Phone": "1"},
                        {"CustomerID": 2, "Name": "B", "Email": "b", "Phone": "2"}])
    schema = S._struct("CustomerID long, Name string, Email string, Phone string, At int")
    changes = frame(spark, schema,
                    {"CustomerID": 1, "Name": "X", "Email": "x", "At": 1},
                    {"CustomerID": 1, "Name": "Y", "Email": None, "At": 2},
                    {"CustomerID": 3, "Name": "Z", "At": 1})
    after = state.upsert_customers(t, changes, "-At")
    assert sorted(rows(after), key=str) == [
        (1, "Y", None, None), (2, "B", "b", "2"), (3, "Z", None, None)]
    again = state.upsert_customers(t.replace(customers=after), changes, "-At")
    assert sorted(rows(again), key=str) == sorted(rows(after), key=str)


def test_new_books_get_quantities(spark, shop):
    t = shop(books=[{"BookID": 1, "Title": "T", "Stock": 1}])
    schema = S._struct("BookID long, Title string, Author string, Genre string, Price money, Stock int, "
                       "InputQuantity long, OutputQuantity long, SupplierID long, At int")
    changes = frame(spark, schema, {"BookID": 1, "Title": "U", "Stock": 4, "At": 1},
                    {"BookID": 2, "InputQuantity": 9, "OutputQuantity": 2, "Stock": 5, "At": 1})
    after = state.upsert_books(t, changes, "-At")
    assert sorted(rows(after, "BookID", "Title", "Stock", "InputQuantity", "OutputQuantity")) == [
        (1, "U", 4, 4, 0), (2, None, 7, 9, 2)]


def test_promotion_update_keeps_use_count(spark, shop):
    t = shop(promotions=[{"PromotionID": 1, "PromotionCode": "A", "UsedCount": 7, "CreatedAt": "2024-01-01"}])
    at = "2024-05-05 10:00:00"
    changes = frame(spark, S.PROMOTIONS, {"PromotionID": 1, "PromotionCode": "B", "UpdatedAt": at},
                    {"PromotionID": 2, "PromotionCode": "N", "UpdatedAt": at})
    after = state.upsert_promotions(t, changes, "-UpdatedAt")
    assert sorted(rows(after.withColumn("d", F.to_date("CreatedAt")), "PromotionID", "PromotionCode", "UsedCount", "d")) == [
        (1, "B", 7, dt.date(2024, 1, 1)), (2, "N", 0, dt.date(2024, 5, 5))]


def test_order_update_touches_three_columns(spark, shop):
    t = shop(orders=[{"OrderID": 1, "CustomerID": 1, "OrderDate": "2024-01-01", "TotalAmount": 5, "SubTotal": 5}])
    changes = frame(spark, S.ORDERS, {"OrderID": 1, "CustomerID": 2, "OrderDate": "2024-02-02", "TotalAmount": None},
                    {"OrderID": 9, "CustomerID": 2})
    after = state.update_orders(t, changes, "-OrderDate")
    assert rows(after, "OrderID", "CustomerID", "OrderDate", "TotalAmount", "SubTotal") == [
        (1, 2, dt.date(2024, 2, 2), None, 5.0)]


def test_backfills(shop):
    t = shop(orders=[{"OrderID": 1, "OrderDate": "2024-01-01", "TotalAmount": 5, "PaymentStatus": "pending"},
                     {"OrderID": 2, "OrderDate": "2024-01-01", "TotalAmount": 5, "PaymentMethodID": 2,
                      "PaymentStatus": "pending"}],
             books=[{"BookID": 1, "Stock": 4}, {"BookID": 2, "Stock": 4, "InputQuantity": 6, "OutputQuantity": 2}])
    assert sorted(rows(state.backfill_orders(t), "OrderID", "PaymentMethodID", "PaymentStatus", "SubTotal")) == [
        (1, 1, "paid", 5.0), (2, 2, "pending", None)]
    assert sorted(rows(state.backfill_quantities(t.books), "InputQuantity", "OutputQuantity")) == [(4, 0), (6, 2)]


def test_replace_targets(spark, shop):
    t = shop(promotion_targets=[{"TargetID": i, "PromotionID": p, "TargetType": "customer"}
                                for i, p in ((1, 1), (2, 1), (3, 2), (4, 3))])
    changes = frame(spark, S.PROMOTION_TARGETS, {"TargetID": 9, "PromotionID": 1, "TargetType": "product", "TargetID_Value": 5},
                    {"TargetID": 10, "PromotionID": 2, "TargetType": "all"})
    assert sorted(rows(state.replace_targets(t.promotion_targets, changes), "TargetID", "TargetType")) == [
        (4, "customer"), (9, "product")]


EVENT = S._struct("EventID long, OrderID long, At timestamp, Status string, PaymentMethodID int, TransactionID string")


def test_payment_fold(spark, shop):
    t = shop(orders=[{"OrderID": i, "PaymentStatus": "pending", "PaymentMethodID": 1, "TransactionID": "old"} for i in (1, 2, 3)])
    events = frame(
        spark, EVENT,
        {"EventID": 1, "OrderID": 1, "At": "2024-01-01", "Status": "paid", "PaymentMethodID": 3, "TransactionID": "a"},
        {"EventID": 2, "OrderID": 1, "At": "2024-01-02", "Status": "refunded", "TransactionID": None},
        {"EventID": 4, "OrderID": 2, "At": "2024-01-05", "Status": "failed", "TransactionID": "c"},
        {"EventID": 3, "OrderID": 2, "At": "2024-01-05", "Status": "paid", "PaymentMethodID": 2, "TransactionID": "b"},
        {"EventID": 5, "OrderID": 99, "At": "2024-01-05", "Status": "paid"},
    )
    after = state.apply_payments(t.orders, events).withColumn("day", F.to_date("PaymentDate"))
    assert sorted(rows(after, "OrderID", "PaymentStatus", "PaymentMethodID", "TransactionID", "day")) == [
        (1, "refunded", 3, None, dt.date(2024, 1, 1)), (2, "failed", 2, "c", dt.date(2024, 1, 5)),
        (3, "pending", 1, "old", None)]


BOOKS = [{"BookID": 1, "Stock": 7, "InputQuantity": 10, "OutputQuantity": 3},
         {"BookID": 2, "Stock": 5, "InputQuantity": 5, "OutputQuantity": 0}]
LINES = [{"OrderID": 1, "BookID": 1, "Quantity": 2, "Price": 1}, {"OrderID": 2, "BookID": 1, "Quantity": 1, "Price": 1},
         {"OrderID": 2, "BookID": 8, "Quantity": 1, "Price": 1}]


def test_ledger_and_adjustments(spark, shop):
    t = shop(books=BOOKS, order_details=LINES)
    assert rows(state.stock_drift(t)) == []
    deltas = spark.createDataFrame([(1, 3), (1, -1), (9, 5)], "BookID long, Delta long")
    moved = t.replace(books=state.adjust_stock(t, deltas))
    assert sorted(rows(moved.books, "BookID", "Stock")) == [(1, 9), (2, 5)]
    assert rows(state.stock_drift(moved), "BookID", "Sold", "LedgerStock", "Drift") == [(1, 3, 7, 2)]
    assert rows(state.stock_drift(moved.replace(books=state.reconcile_books(moved)))) == []


def test_cancelling_gives_stock_back(spark, shop):
    t = shop(books=BOOKS, order_details=LINES, orders=[{"OrderID": i} for i in (1, 2, 3)],
             promotion_usage=[{"UsageID": 1, "OrderID": 3}, {"UsageID": 2, "OrderID": 3}])
    ids = spark.createDataFrame([(2,), (3,), (4,), (2,)], "OrderID long")
    assert sorted(rows(state.cancel_outcomes(t, ids))) == [(2, "cancelled"), (3, "has_promotion_usage"), (4, "unknown")]
    after = state.cancel_orders(t, ids)
    assert sorted(rows(after.orders, "OrderID")) == [(1,), (3,)]
    assert rows(after.order_details, "OrderID") == [(1,)]
    assert sorted(rows(after.books, "BookID", "Stock", "OutputQuantity")) == [(1, 8, 2), (2, 5, 0)]
    assert rows(state.stock_drift(after)) == []
