import datetime as dt
import random

import pytest
from shop_frames import frame, rows

from ledgerlane import schema as S
from ledgerlane.operators.allocation import allocate
from ledgerlane.operators.running import running_before, with_buckets
from ledgerlane.plans import state
from ledgerlane.plans.ordering import price_orders, take_orders
from ledgerlane.session import Scratch
from pyspark.sql import functions as F

NOW = dt.datetime(2024, 6, 15, 12)
HEADER = S._struct("OrderID long, CustomerID long, OrderDate string, PromotionCode string, PaymentMethodID int, "
                   "TotalAmount money")
LINE = S._struct("OrderID long, Position int, BookID long, Quantity int, Price money")


def one_by_one(books, limits, orders):
    """The plain sequential process: the yardstick for the distributed one."""
    stock, used, pairs, fates = dict(books), {}, set(), {}
    for number, customer, promo, items in sorted(orders):
        titles = [b for b, _ in items]
        if len(titles) != len(set(titles)):
            fates[number] = "repeated_book"
        elif promo and promo in limits and used.get(promo, 0) >= limits[promo]:
            fates[number] = "promotion_exhausted"
        elif promo and (promo, customer) in pairs:
            fates[number] = "already_used"
        elif any(stock.get(b, 0) < q for b, q in items):
            fates[number] = "insufficient_stock"
        else:
            fates[number] = None
            for b, q in items:
                stock[b] -= q
            if promo:
                used[promo] = used.get(promo, 0) + 1
                pairs.add((promo, customer))
    return fates, stock


def setting(spark, shop, books, limits, orders):
    promotions = [{"PromotionID": p, "PromotionCode": f"P{p}", "DiscountType": "fixed_amount", "DiscountValue": 1,
                   "MinimumOrderAmount": 0, "StartDate": "2024-01-01", "EndDate": "2024-12-31", "IsActive": True,
                   "UsageLimit": limits.get(p), "UsedCount": 0} for p in (1, 2, 3)]
    t = shop(books=[{"BookID": b, "Stock": s, "InputQuantity": s + 2, "OutputQuantity": 2} for b, s in books.items()],
             promotions=promotions, payment_methods=[{"PaymentMethodID": 1, "IsActive": True},
                                                     {"PaymentMethodID": 2, "IsActive": False}])
    headers = frame(spark, HEADER, *(
        {"OrderID": n, "CustomerID": c, "OrderDate": "2024-06-15", "PromotionCode": f"P{p}" if p else None,
         "PaymentMethodID": 1, "TotalAmount": 1} for n, c, p, _ in orders))
    lines = frame(spark, LINE, *(
        {"OrderID": n, "Position": i, "BookID": b, "Quantity": q, "Price": 2}
        for n, _, _, items in orders for i, (b, q) in enumerate(items)))
    return t, headers, lines


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_taking_orders_equals_one_by_one(spark, shop, seed):
    dice = random.Random(seed)
    books = {b: dice.randint(0, 30) for b in range(1, 9)}
    limits = {1: 5, 2: 2}
    orders = []
    for number in dice.sample(range(1000), 120):
        # a third of all lines ask for one book, a third of all orders use one promotion
        items = [(1 if dice.random() < 0.33 else dice.randint(1, 9), dice.randint(1, 4))
                 for _ in range(dice.randint(1, 3))]
        orders.append((number, dice.randint(1, 20), dice.choice([1, 1, 2, 3, None, None]), items))
    t, headers, lines = setting(spark, shop, books, limits, orders)
    fates, stock = one_by_one(books, limits, orders)
    taken = take_orders(t, headers, lines, NOW, Scratch(spark, "test"))
    assert dict(rows(taken.decisions, "OrderID", "Reason")) == fates
    assert {n for n, ok in rows(taken.decisions, "OrderID", "Accepted") if ok} == {
        n for n, fate in fates.items() if fate is None}
    assert dict(rows(taken.books, "BookID", "Stock")) == stock
    assert min(stock.values()) >= 0
    ledger = rows(taken.books, "Stock", "InputQuantity", "OutputQuantity")
    assert all(s == i - o for s, i, o in ledger)
    granted = {n for n, fate in fates.items() if fate is None}
    uses = [p for n, _, p, _ in orders if n in granted and p]
    assert dict(rows(taken.promotions, "PromotionID", "UsedCount")) == {p: uses.count(p) for p in (1, 2, 3)}
    assert taken.promotion_usage.count() == len(uses)


def test_refusal_frees_stock_for_later_orders(spark, shop):
    orders = [(1, 1, None, [(1, 3), (2, 9)]), (2, 1, None, [(1, 2)]), (3, 1, None, [(1, 2), (3, 1)]),
              (4, 1, None, [(1, 1)])]
    t, headers, lines = setting(spark, shop, {1: 3, 2: 5}, {}, orders)
    taken = take_orders(t, headers, lines, NOW, Scratch(spark, "test"))
    short = "insufficient_stock"
    assert dict(rows(taken.decisions, "OrderID", "Reason")) == {1: short, 2: None, 3: short, 4: None}
    assert dict(rows(taken.books, "BookID", "Stock")) == {1: 0, 2: 5}
    # cancelling what was taken restores the books
    after = t.replace(books=taken.books, orders=taken.orders, order_details=taken.order_details)
    undone = state.cancel_orders(after, taken.orders.select("OrderID"))
    assert sorted(rows(undone.books)) == sorted(rows(t.books))


def test_earlier_uses_count(spark, shop):
    orders = [(1, 1, 1, [(1, 1)]), (2, 2, 1, [(1, 1)]), (3, 3, 1, [(1, 1)])]
    t, headers, lines = setting(spark, shop, {1: 9}, {1: 2}, orders)
    t = t.replace(
        promotions=t.promotions.withColumn("UsedCount", F.lit(1)),
        promotion_usage=frame(spark, S.PROMOTION_USAGE, {"UsageID": 1, "PromotionID": 1, "CustomerID": 1}))
    taken = take_orders(t, headers, lines, NOW, Scratch(spark, "test"))
    assert dict(rows(taken.decisions, "OrderID", "Reason")) == {
        1: "promotion_refused", 2: None, 3: "promotion_exhausted"}


def test_pricing_reasons_and_amounts(spark, shop):
    orders = [(1, 1, 3, [(1, 2), (2, 1)]), (2, 1, None, [(1, 1)]), (3, 1, None, [(1, 1)]), (4, 0, 3, [(1, 1)])]
    t, headers, lines = setting(spark, shop, {1: 9}, {}, orders)
    headers = headers.withColumns({
        "PromotionCode": F.when(F.col("OrderID") == 2, "NOPE").otherwise(F.col("PromotionCode")),
        "PaymentMethodID": F.when(F.col("OrderID") == 3, 2).otherwise(F.col("PaymentMethodID"))})
    priced = price_orders(t, headers, lines, NOW)
    assert sorted(rows(priced, "OrderID", "SubTotal", "DiscountAmount", "TotalAmount", "Reason")) == [
        (1, 6.0, 1.0, 5.0, None), (2, 2.0, 0.0, 2.0, "promotion_refused"),
        (3, 2.0, 0.0, 2.0, "bad_payment_method"), (4, 2.0, 1.0, 1.0, "customer_missing")]


def test_running_sums_in_buckets(spark):
    dice = random.Random(5)
    data = [(g, n, dice.randint(-5, 9)) for g in (1, 1, 1, 2) for n in range(200)]
    data = list({(g, n): v for g, n, v in data}.items())
    df = spark.createDataFrame([(g, n, v) for (g, n), v in data], "g int, n long, v int")
    cut = Scratch(spark, "test").save(with_buckets(df, "n", 9), "cut")
    assert cut.select("Bucket").distinct().count() > 3
    sums = {"before": F.col("v")}
    plain = running_before(df, ["g"], "n", sums).select("g", "n", "before")
    spread = running_before(cut, ["g"], "n", sums, "Bucket").select("g", "n", "before")
    assert sorted(rows(plain)) == sorted(rows(spread))


DEMAND = S._struct("OrderID long, Kind int, Quantity long")
CAPACITY = S._struct("Kind int, Capacity long")


def serve(wants: dict[int, dict[int, int]], capacity: dict[int, int]) -> set[int]:
    left, granted = dict(capacity), set()
    for number in sorted(wants):
        if all(left.get(k, 0) >= q for k, q in wants[number].items()):
            granted.add(number)
            for k, q in wants[number].items():
                left[k] -= q
    return granted


def allocated(spark, wants, capacity, fold_rows):
    demand = spark.createDataFrame([(n, k, q) for n, own in wants.items() for k, q in own.items()], DEMAND)
    held = spark.createDataFrame(list(capacity.items()), CAPACITY)
    return allocate(demand.select("OrderID").distinct(), demand, held, ["Kind"], Scratch(spark, "test"), fold_rows)


@pytest.mark.parametrize("fold_rows", [0, 30, 120])
def test_rounds_clusters_and_folds_grant_the_same(spark, fold_rows):
    dice = random.Random(11)
    wants = {}
    for n in dice.sample(range(5000), 260):
        of = dice.randrange(12) * 10  # twelve shops that share no book, one with most of the orders
        of = 0 if dice.random() < 0.4 else of
        wants[n] = {of + k: dice.randint(1, 5) for k in dice.sample(range(6), dice.randint(1, 3))}
    capacity = {shop * 10 + k: dice.randint(0, 25) for shop in range(12) for k in range(6)}
    served = allocated(spark, wants, capacity, fold_rows)
    assert {n for n, in rows(served.granted)} == serve(wants, capacity)


def test_a_chain_of_ten_thousand_orders_takes_no_round(spark):
    """Each wants what the one before leaves: bounds would settle it link by link."""
    wants = {n: {n: 1, n + 1: 1} for n in range(10_000)}
    served = allocated(spark, wants, dict.fromkeys(range(10_001), 1), 100_000)
    assert served.rounds == 0 and {n for n, in rows(served.granted)} == set(range(0, 10_000, 2))


def test_chains_are_clusters_of_their_own(spark):
    wants = {chain * 1000 + n: {chain * 1000 + n: 1, chain * 1000 + n + 1: 1} for chain in range(40) for n in range(60)}
    capacity = {chain * 1000 + n: 1 for chain in range(40) for n in range(61)}
    served = allocated(spark, wants, capacity, 500)  # all chains together are more than one task may hold
    assert served.rounds == 1 and {n for n, in rows(served.granted)} == serve(wants, capacity)


def test_no_demand_and_plenty(spark):
    schema = S._struct("OrderID long, Kind int, Quantity long")
    capacity = frame(spark, S._struct("Kind int, Capacity long"), {"Kind": 1, "Capacity": 5})
    nobody = frame(spark, schema)
    served = allocate(nobody, nobody, capacity, ["Kind"], Scratch(spark, "test"))
    assert served.rounds == 0 and rows(served.granted) == []
    plenty = frame(spark, schema, {"OrderID": 1, "Kind": 1, "Quantity": 2}, {"OrderID": 2, "Kind": 1, "Quantity": 3})
    served = allocate(plenty, plenty, capacity, ["Kind"], Scratch(spark, "test"))
    assert served.rounds == 0 and sorted(rows(served.granted)) == [(1,), (2,)]
    assert rows(served.shortages()) == []
