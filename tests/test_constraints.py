import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from shop_frames import frame, rows

from ledgerlane import schema as S
from ledgerlane.operators import membership
from ledgerlane.plans import constraints
from ledgerlane.plans.constraints import ORDER_DETAILS, ORDERS, order_numbers, take_once, with_references
from ledgerlane.session import Scratch
from test_ordering import HEADER, LINE, setting

NOW = dt.datetime(2024, 6, 15, 12)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_filter_lets_every_key_pass_and_few_others(spark):
    keys = spark.range(0, 40_000, 2).select(F.col("id").alias("k"))
    bits = membership.filter_bits(20_000)
    known = membership.key_filter(keys, ["k"], bits)
    assert known.count() <= bits // membership.BLOCK
    passed = {r.k for r in membership.maybe_among(spark.range(40_000).select(F.col("id").alias("k")), ["k"], known, bits).collect()}
    assert passed >= set(range(0, 40_000, 2))
    assert len(passed) - 20_000 < 20_000 * 0.1
    assert membership.filter_bits(10 ** 12) == membership.MOST_BITS and membership.filter_bits(0) == membership.BLOCK


def test_filter_of_nothing_and_of_negative_and_text_keys(spark):
    df = spark.createDataFrame([(-5, "a"), (7, "b"), (None, "c")], "k long, s string")
    bits = membership.filter_bits(3)
    assert membership.maybe_among(df, ["k"], membership.key_filter(df.limit(0), ["k"], bits), bits).count() == 0
    assert membership.maybe_among(df, ["k", "s"], membership.key_filter(df, ["k", "s"], bits), bits).count() == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_first_missing_reference(spark, shop, seed):
    dice = random.Random(seed)
    customers, methods, promos = ({dice.randrange(30) for _ in range(15)} for _ in range(3))
    t = shop(customers=[{"CustomerID": c} for c in customers], payment_methods=[{"PaymentMethodID": m} for m in methods],
             promotions=[{"PromotionID": p} for p in promos])
    # a third of the rows name one customer, a third of the promotions is null
    batch = [{"OrderID": n, "CustomerID": 99 if n % 3 == 0 and seed == 2 else dice.choice([None, *range(30)]),
              "PaymentMethodID": dice.choice([None, *range(30)]), "PromotionID": dice.choice([None] * 9 + list(range(30)))}
             for n in range(300)]
    judged = with_references(t, frame(spark, S.ORDERS, *batch), ORDERS, Scratch(spark, "test"), ("OrderID",))
    assert judged.schema.names == [*S.ORDERS.names, "Reason"] and judged.select(*S.ORDERS.names).schema == S.ORDERS

    def reason(r):
        for name, known, text in (("CustomerID", customers, "unknown_customer"),
                                  ("PaymentMethodID", methods, "unknown_payment_method"),
                                  ("PromotionID", promos, "unknown_promotion")):
            if r[name] is not None and r[name] not in known:
                return text
        return None

    assert dict(rows(judged, "OrderID", "Reason")) == {r["OrderID"]: reason(r) for r in batch}


def test_empty_batch_and_empty_tables(spark, shop):
    t = shop()
    none = frame(spark, S.ORDER_DETAILS)
    assert with_references(t, none, ORDER_DETAILS, Scratch(spark, "test"), ("OrderID", "BookID")).count() == 0
    some = frame(spark, S.ORDER_DETAILS, {"OrderID": 1, "BookID": 2}, {"OrderID": None, "BookID": 2}, {"OrderID": None})
    judged = with_references(t, some, ORDER_DETAILS, Scratch(spark, "test"), ("OrderID", "BookID"))
    assert sorted(rows(judged, "Reason"), key=str) == [("unknown_book",), ("unknown_order",), (None,)]


def test_each_referenced_table_is_scanned_once(spark, shop, tmp_path, monkeypatch):
    for name, rows_of in (("customers", 50), ("promotions", 20), ("orders", 5)):
        key = {"customers": "CustomerID", "promotions": "PromotionID", "orders": "OrderID"}[name]
        frame(spark, S.SCHEMAS[name], *({key: k} for k in range(rows_of))).write.parquet(f"{tmp_path}/{name}")
    t = shop().replace(**{n: spark.read.schema(S.SCHEMAS[n]).parquet(f"{tmp_path}/{n}") for n in ("customers", "promotions", "orders")})
    batch = frame(spark, S.PROMOTION_USAGE, {"UsageID": 1, "PromotionID": 1, "OrderID": 9, "CustomerID": 2})
    plans = []
    saved = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: (plans.append((name, plan(df))), saved(self, df, name))[1])
    judged = with_references(t, batch, constraints.PROMOTION_USAGE, Scratch(spark, "test"), ("UsageID",))
    assert rows(judged, "Reason") == [("unknown_order",)]
    missing = dict(plans)["missing"].split("== Physical Plan ==")[1]
    for key in ("CustomerID", "PromotionID", "OrderID"):
        assert missing.count(f"FileScan parquet [{key}#") == 1
    assert "CartesianProduct" not in missing and "Python" not in missing


def test_stored_and_repeated_numbers(spark):
    batch = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 5), (3, 4), (4, 1)], "OrderID long, Delivery int")
    stored = spark.createDataFrame([(2,), (4,), (77,)], "OrderID long")
    judged = order_numbers(stored, batch, Scratch(spark, "test"), "Delivery")
    assert sorted(rows(judged, "OrderID", "Delivery", "NumberReason"), key=str) == sorted([
        (1, 1, None), (1, 2, "repeated_request"), (2, 1, "order_exists"), (3, 4, None), (3, 5, "repeated_request"),
        (4, 1, "order_exists")], key=str)


def deliveries(spark, shop, orders):
    t, headers, lines = setting(spark, shop, {1: 6, 2: 3}, {}, [o for o in orders])
    t = t.replace(customers=frame(spark, S.CUSTOMERS, *({"CustomerID": c} for c in (1, 2))),
                  orders=frame(spark, S.ORDERS, {"OrderID": 50}))
    return t, headers.withColumn("Delivery", F.lit(1)), lines.withColumn("Delivery", F.lit(1))


def test_each_number_is_served_once_and_for_known_customers(spark, shop):
    orders = [(1, 1, None, [(1, 2)]), (2, 9, None, [(1, 1)]), (3, 2, None, [(1, 5)]), (50, 1, None, [(2, 1)]),
              (4, 2, None, [(1, 4), (2, 3)])]
    t, headers, lines = deliveries(spark, shop, orders)
    again = F.col("OrderID").isin(1, 3)
    headers = headers.unionByName(headers.filter(again).withColumn("Delivery", F.lit(2)))
    lines = lines.unionByName(lines.filter(again).withColumns({"Delivery": F.lit(2), "Quantity": F.lit(1)}))
    decisions, taken = take_once(t, headers, lines, NOW, Scratch(spark, "test"))
    assert dict(((n, d), r) for n, d, r in rows(decisions, "OrderID", "Delivery", "Reason")) == {
        (1, 1): None, (2, 1): "unknown_customer", (3, 1): "insufficient_stock", (50, 1): "order_exists", (4, 1): None,
        (1, 2): "repeated_request", (3, 2): "repeated_request"}
    assert sorted(rows(taken.orders, "OrderID")) == [(1,), (4,)]
    assert dict(rows(taken.books, "BookID", "Stock")) == {1: 0, 2: 0}
    assert HEADER.names == [c for c in headers.columns if c != "Delivery"] and "Position" in LINE.names
