import datetime as dt

import pytest
from shop_frames import frame, one, rows
from pyspark.sql import functions as F

from ledgerlane import schema as S
from ledgerlane.functions.values import discount
from ledgerlane.plans import promotions as P

NOW = dt.datetime(2024, 6, 15, 12)


@pytest.mark.parametrize("kind, value, cap, amount, expected", [
    ("percentage", 10, None, 200, 20.0),
    ("percentage", 10, 0, 200, 20.0),  # a zero cap is no cap
    ("percentage", 10, 15, 200, 15.0),
    ("percentage", 10, 20, 200, 20.0),
    ("percentage", 100, None, 200, 200.0),
    ("percentage", 33, None, 0.05, 0.02),  # 0.0165, rounded half up
    ("fixed_amount", 30, 5, 200, 30.0),  # caps are for percentages only
    ("fixed_amount", 300, None, 200, 200.0),
    (None, None, None, 200, None),
])
def test_discount(spark, kind, value, cap, amount, expected):
    schema = S._struct("kind string, value money, cap money, amount money")
    df = frame(spark, schema, {"kind": kind, "value": value, "cap": cap, "amount": amount})
    got = df.select(discount(*(F.col(c) for c in ("kind", "value", "cap", "amount"))).alias("d"))
    assert one(got)["d"] == expected


def promotion(number, code, **changes):
    return {
        "PromotionID": number, "PromotionCode": code, "DiscountType": "percentage", "DiscountValue": 10,
        "MinimumOrderAmount": 100, "StartDate": "2024-06-15", "EndDate": "2024-06-15", "IsActive": True,
        "UsedCount": 0, **changes,
    }


PROMOTIONS = [
    promotion(1, "OK"), promotion(2, "OFF", IsActive=False), promotion(3, "OVER", EndDate="2024-06-14"),
    promotion(4, "SOON", StartDate="2024-06-16"), promotion(5, "GONE", UsageLimit=3, UsedCount=3),
    promotion(6, "LAST", UsageLimit=3, UsedCount=2), promotion(7, "AIMED"),
]
REQUEST = S._struct("OrderID long, CustomerID long, PromotionCode string, SubTotal money")
LINE = S._struct("OrderID long, BookID long, Quantity int, Price money")


def judge(spark, shop, requests, lines=(), **tables):
    t = shop(promotions=PROMOTIONS, **tables)
    judged = P.validate_promotions(
        t, frame(spark, REQUEST, *requests), frame(spark, LINE, *lines), NOW)
    return dict(rows(judged, "OrderID", "PromotionReason"))


def test_which_rule_fails_first(spark, shop):
    codes = ["OK", "ok", "OFF", "OVER", "SOON", "GONE", "LAST", "NONE", None]
    requests = [{"OrderID": i, "CustomerID": 1, "PromotionCode": c, "SubTotal": 100} for i, c in enumerate(codes)]
    bad = "unknown_or_inactive"
    assert judge(spark, shop, requests) == {
        0: None, 1: None, 2: bad, 3: bad, 4: bad, 5: bad, 6: None, 7: bad, 8: bad}


def test_minimum_comes_before_use_and_use_before_target(spark, shop):
    requests = [
        {"OrderID": 1, "CustomerID": 1, "PromotionCode": "AIMED", "SubTotal": 99.99},
        {"OrderID": 2, "CustomerID": 1, "PromotionCode": "AIMED", "SubTotal": 100},
        {"OrderID": 3, "CustomerID": 2, "PromotionCode": "AIMED", "SubTotal": 100},
        {"OrderID": 4, "CustomerID": 3, "PromotionCode": "AIMED", "SubTotal": 100},
    ]
    used = [{"UsageID": i, "PromotionID": 7, "OrderID": 90 + i, "CustomerID": 1, "DiscountAmount": 1} for i in (1, 2)]
    targets = [{"TargetID": 1, "PromotionID": 7, "TargetType": "customer", "TargetID_Value": 3}]
    assert judge(spark, shop, requests, promotion_usage=used, promotion_targets=targets) == {
        1: "below_minimum", 2: "already_used", 3: "not_targeted", 4: None}


def walk(targets, customer, books):
    """The target rules one after the other."""
    for kind, value in targets:
        if kind == "all":
            return True
        if kind == "customer" and value and value != customer:
            return False
        if kind == "product" and value and value not in books:
            return False
    return True


@pytest.mark.parametrize("targets", [
    [],
    [("all", None)],
    [("customer", None)], [("customer", 1)], [("customer", 2)], [("customer", 0)],
    [("product", 10)], [("product", 11)], [("product", 77)], [("product", None)], [("product", 0)],
    [("category", 5)],
    [("customer", 2), ("all", None)],
    [("all", None), ("customer", 2)],
    [("category", None), ("product", 10), ("product", 77)],
    [("product", 10), ("customer", 1), ("category", 3)],
    [("customer", 1), ("all", None), ("product", 77)],
])
def test_targets_match_the_walk(spark, shop, targets):
    stored = [{"TargetID": i, "PromotionID": 7, "TargetType": k, "TargetID_Value": v}
              for i, (k, v) in enumerate(targets)]
    requests = [{"OrderID": 5, "CustomerID": 1, "PromotionCode": "AIMED", "SubTotal": 500}]
    lines = [{"OrderID": 5, "BookID": b, "Quantity": 1, "Price": 1} for b in (10, 11, 10)]
    reason = judge(spark, shop, requests, lines, promotion_targets=stored)[5]
    assert (reason is None) == walk(targets, 1, {10, 11})


def test_usage_rollup_and_history(spark, shop):
    orders = [{"OrderID": i, "CustomerID": i, "OrderDate": "2024-06-01", "PromotionID": p, "DiscountAmount": 2}
              for i, p in enumerate([6, 6, None, 1])]
    t = shop(promotions=PROMOTIONS, orders=orders)
    raised, used = P.usage_rollup(t, t.orders, F.lit(NOW))
    counts = dict(rows(raised, "PromotionID", "UsedCount"))
    assert (counts[6], counts[1], counts[2]) == (4, 1, 0)
    assert sorted(rows(used, "OrderID", "PromotionID", "DiscountAmount")) == [(0, 6, 2.0), (1, 6, 2.0), (3, 1, 2.0)]
    t = t.replace(promotion_usage=used)
    who = t.orders.select("CustomerID").filter("CustomerID < 2")
    assert rows(P.usage_history(t, who, ordered=True), "OrderID", "PromotionCode", "OrderDate") == [
        (1, "LAST", dt.date(2024, 6, 1)), (0, "LAST", dt.date(2024, 6, 1))]
    codes = spark.createDataFrame([("last",), ("LAST",), ("off",)], "PromotionCode string")
    assert rows(P.promotions_by_code(t, codes, NOW), "PromotionCode") == [("LAST",)]
