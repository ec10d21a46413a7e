"""Properties of the physical plans that matter on large tables."""

import datetime as dt
import os
import re

import pytest

import __spark_entry__ as entry
from ledgerlane.plans import orders
from ledgerlane.sources import star
from ledgerlane.sources.layout import clustered_tables, save_clustered

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# These run jobs while they are built; what they return only reads results back.
EAGER = {n for n in entry._QUERIES if n.startswith(("stream_", "take_orders"))}


@pytest.mark.parametrize("name", [n for n in entry._QUERIES if n not in EAGER])
def test_no_python_and_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, ROOT))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name, scans", [
    ("dash_order_recency", 1), ("rev_summary", 1), ("dash_inventory", 1), ("dash_overview", 4),
    ("dash_sales_trends", 1), ("dash_top_books", 2), ("dash_genre", 2), ("apply_payments", 2),
])
def test_scans(spark, name, scans):
    text = plan(entry.queries()[name](spark, ROOT))
    assert len(re.findall(r"FileScan parquet", text)) == scans


def test_recency_filter_reaches_the_scan(spark):
    text = plan(entry.queries()["dash_monthly"](spark, ROOT))
    assert "GreaterThanOrEqual(o_orderdate,2000-08-02T00:00)" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_top_k_needs_no_global_sort(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["dash_top_books"](spark, ROOT))


def test_latest_per_key_limits_before_the_shuffle(spark):
    text = plan(entry.queries()["update_orders"](spark, ROOT))
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_clustered_tables_join_without_shuffling(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    t = star.star_tables(spark, ROOT)
    save_clustered(t, "shop", 4)
    kept = clustered_tables(spark, "shop", t)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = orders.with_item_count(kept, kept.orders)
        assert "Exchange" not in plan(counted)
        assert counted.count() == t.orders.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_range_of_orders_is_pushed_down(spark):
    t = star.star_tables(spark, ROOT)
    text = plan(orders.orders_between(t, dt.date(1998, 1, 1), dt.date(1998, 12, 31)))
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in text


def test_rows_without_promotion_are_spread(spark):
    """Most orders have no promotion: their join key must not be one and the same null."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(entry.queries()["order_list"](spark, ROOT))
        assert re.search(r"SortMergeJoin \[_key#\d+L?\], \[_key#\d+L?\], LeftOuter", text)
        assert re.search(r"coalesce\(PromotionID#\d+L, \(-1 - OrderID#\d+L\)\) AS _key", text)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_book_is_summed_before_the_shuffle(spark):
    text = plan(entry.queries()["dash_genre"](spark, ROOT))
    assert re.search(r"HashAggregate\(keys=\[BookID#\d+L\], functions=\[partial_count", text)
