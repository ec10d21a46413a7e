import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from shop_frames import frame, rows

from ledgerlane import schema as S
from ledgerlane.plans import dashboard as D
from ledgerlane.plans import revenue as V
from ledgerlane.plans import rollup as R

NOW = dt.datetime(2024, 6, 30, 12)


def some_orders(seed: int, n: int = 400) -> list[dict]:
    """A third of the orders are one customer's; customers lie in several blocks, some are missing."""
    dice = random.Random(seed)
    return [{
        "OrderID": i, "OrderDate": (NOW - dt.timedelta(days=dice.choice([0, 1, 5, 29, 30, 31, 200, 365, 366, 800]))).date().isoformat(),
        "CustomerID": 7 if i % 3 == 0 else dice.choice([None, 0, 7, 32_767, 32_768, 90_000, 10 ** 12, dice.randrange(70_000)]),
        "TotalAmount": None if dice.random() < 0.1 else dice.randrange(1, 99999) / 100,
    } for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_from_the_rollup_equal_those_from_orders(spark, shop, seed):
    t = shop(orders=some_orders(seed))
    days = R.sales_rollup(t.orders)
    pairs = [
        (R.monthly(days, NOW), D.monthly(t, NOW)), (R.customer_growth(days, NOW), D.customer_growth(t, NOW)),
        (R.sales_trends(days, NOW), D.sales_trends(t, NOW)), (R.sales_chart(days, NOW), D.sales_chart(t, NOW)),
        (R.sales_chart(days, NOW, "day"), D.sales_chart(t, NOW, "day")), (R.order_recency(days, NOW), D.order_recency(t, NOW)),
        (R.weekly(days, NOW), V.weekly(t, NOW)), (R.monthly_revenue(days, NOW), V.monthly(t, NOW)),
        (R.yearly(days), V.yearly(t)), (R.summary(days, NOW), V.summary(t, NOW)),
        (D.overview(t, NOW, R.order_totals(days, NOW)), D.overview(t, NOW)),
    ]
    for rolled, plain in pairs:
        assert rolled.columns == plain.columns
        assert sorted(rows(rolled), key=str) == sorted(rows(plain), key=str)


def test_no_orders(spark, shop):
    t = shop()
    days = R.sales_rollup(t.orders)
    assert rows(R.summary(days, NOW)) == rows(V.summary(t, NOW)) and R.monthly(days, NOW).count() == 0
    assert rows(D.overview(t, NOW, R.order_totals(days, NOW))) == rows(D.overview(t, NOW))


def test_refresh_rewrites_touched_months_only_and_may_be_repeated(spark, tmp_path):
    path = str(tmp_path / "days")
    old = frame(spark, S.ORDERS, *some_orders(3))
    R.write_rollup(R.sales_rollup(old), path)
    before = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("Folder=")}
    late = frame(spark, S.ORDERS, *({"OrderID": 9000 + i, "OrderDate": day, "CustomerID": 7 + i, "TotalAmount": 5}
                                    for i, day in enumerate(["2024-06-29", "2024-06-02", "2020-02-29"])))
    both = old.unionByName(late)
    for _ in range(2):
        R.refresh(path, both, late)
        stored = R.read_rollup(spark, path, R.sales_rollup(both))
        assert sorted(rows(R.daily(stored))) == sorted(rows(R.daily(R.sales_rollup(both))))
    after = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("Folder=")}
    assert {d for d in after if after[d] != before.get(d)} == {"Folder=2024-06", "Folder=2020-02"}


def test_bundles_read_orders_for_the_rollup_and_the_best_customers_only(spark, shop, tmp_path):
    frame(spark, S.ORDERS, *some_orders(4, 30)).write.parquet(f"{tmp_path}/orders")
    t = shop().replace(orders=spark.read.schema(S.ORDERS).parquet(f"{tmp_path}/orders"))
    plan = V.dashboard_document(t, NOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [CustomerID") <= 1 and "Expand" not in plan
    bundle = V.report_document(V.bundle(t, NOW))._jdf.queryExecution().executedPlan().toString()
    assert "CustomerID" not in bundle


def test_values_have_keys_numbers_and_texts(spark, shop):
    t = shop(orders=[{"OrderID": 1, "OrderDate": "2024-06-30", "CustomerID": 1, "TotalAmount": 3}])
    found = rows(V.values_document(V.bundle(t, NOW)).filter(F.col("Section").isin("yearly", "weekly")), "Section", "Key", "Name", "Number", "Text")
    assert set(found) == {
        ("yearly", "2024", "Year", 2024.0, None), ("yearly", "2024", "OrderCount", 1.0, None),
        ("yearly", "2024", "Revenue", 3.0, None), ("yearly", "2024", "UniqueCustomers", 1.0, None),
        ("weekly", "202426", "WeekNumber", 202426.0, None), ("weekly", "202426", "WeekStart", None, "2024-06-30"),
        ("weekly", "202426", "WeekEnd", None, "2024-06-30"), ("weekly", "202426", "OrderCount", 1.0, None),
        ("weekly", "202426", "Revenue", 3.0, None), ("weekly", "202426", "UniqueCustomers", 1.0, None)}
