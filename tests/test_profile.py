import re

from shop_frames import frame, rows

import __spark_entry__ as entry
from ledgerlane import schema as S
from ledgerlane.plans.profile import constraint_profile, declared, profile
from ledgerlane.sources.star import star_tables
from ledgerlane.sources.tables import Tables

ROOT = "/root/testdata/sf0.001"


def profiled(df, table):
    key, rules = declared()[table]
    found = rows(profile(df, table, key, rules), "Column", "Rule", "Rows", "Violations", "FirstKey", "LastKey")
    return {r[:2]: r[2:] for r in found}


def test_violations_with_first_and_last_key(spark):
    books = frame(
        spark, S.BOOKS,
        {"BookID": 4, "Title": "é" * 100, "Price": "99999999.99", "Stock": 0},
        {"BookID": 9, "Title": "t" * 101, "Price": "100000000.00", "Stock": -1},
        {"BookID": 2, "Title": "t" * 500, "Price": "-100000000.00"},
        {"Title": "t" * 101, "Stock": -7},
    )
    found = profiled(books, "books")
    assert found["Title", "width_100"] == (4, 3, 2, 9)
    assert found["Price", "decimal_10_2"] == (4, 2, 2, 9)
    assert found["Stock", "at_least_0"] == (4, 2, 9, 9)
    assert found["Author", "width_100"] == (4, 0, None, None)


def test_nulls_break_only_given(spark):
    found = profiled(frame(spark, S.PROMOTIONS, {"PromotionID": 1}, {"PromotionID": 1}), "promotions")
    for (_, rule), got in found.items():
        assert got == ((2, 2, 1, 1) if rule == "given" else (2, 0, None, None))


def test_codes_and_dates(spark):
    found = profiled(frame(
        spark, S.PROMOTIONS,
        {"PromotionID": 1, "DiscountType": "Percentage", "DiscountValue": "0.00", "StartDate": "2024-01-02", "EndDate": "2024-01-01"},
        {"PromotionID": 2, "DiscountType": "fixed_amount", "DiscountValue": "0.01", "StartDate": "2024-01-01", "EndDate": "2024-01-01",
         "UsageLimit": 0, "UsedCount": -1},
    ), "promotions")
    assert found["DiscountType", "one_of"] == (2, 1, 1, 1)
    assert found["DiscountValue", "above_0"] == (2, 1, 1, 1)
    assert found["EndDate", "not_before_start"] == (2, 1, 1, 1)
    assert found["UsageLimit", "above_0"] == (2, 1, 2, 2)
    assert found["UsedCount", "at_least_0"] == (2, 1, 2, 2)


def test_empty_tables_have_a_row_for_each_rule(spark):
    empty = Tables({name: frame(spark, schema) for name, schema in S.SCHEMAS.items()})
    found = rows(constraint_profile(empty), "Rows", "Violations", "FirstKey")
    assert len(found) == sum(len(rules) for _, rules in declared().values())
    assert set(found) == {(0, 0, None)}


def test_one_scan_a_table(spark):
    t = star_tables(spark, ROOT)
    for table, (key, rules) in declared().items():
        text = profile(getattr(t, table), table, key, rules)._jdf.queryExecution().executedPlan().toString()
        stored = getattr(t, table)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall("FileScan parquet", text)) == len(re.findall("FileScan parquet", stored)) <= 1
        # the one exchange is that of the tasks' counts
        assert text.count("Exchange SinglePartition") == 1
    assert "constraint_profile" in entry.queries()
