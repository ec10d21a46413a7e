import datetime as dt
import glob
import os

import pyarrow.parquet as pq
import pytest
from shop_frames import frame, rows

from ledgerlane import schema as S
from ledgerlane.operators.relational import lookup
from ledgerlane.plans import dashboard as D
from ledgerlane.plans import orders as O
from ledgerlane.session import Scratch, checkpoint_root
from ledgerlane.sources import requests as R
from ledgerlane.sources import star
from ledgerlane.sources.layout import save_by_date, save_tables
from ledgerlane.sources.tables import Tables, read_tables
from pyspark.sql import functions as F

ROOT = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")
NOW = dt.datetime(2001, 8, 1, 12)


@needs_data
@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_tables_survive_storage(spark, tmp_path, fmt):
    t = star.star_tables(spark, ROOT)
    save_tables(t, str(tmp_path), fmt)
    back = read_tables(spark, str(tmp_path), fmt)
    for name, schema in S.SCHEMAS.items():
        assert getattr(back, name).schema == schema
        assert getattr(back, name).count() == getattr(t, name).count()
    assert rows(D.overview(back, NOW)) == rows(D.overview(t, NOW))
    assert rows(D.ranked_books(back)) == rows(D.ranked_books(t))
    assert sorted(rows(O.order_list(back)), key=str) == sorted(rows(O.order_list(t)), key=str)


@needs_data
def test_adapter_has_the_declared_schemas(spark):
    t = star.star_tables(spark, ROOT)
    for name, schema in S.SCHEMAS.items():
        got = getattr(t, name).schema
        assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in schema]


@needs_data
def test_dates_are_stored_in_ranges(spark, tmp_path):
    save_by_date(star.orders(spark, ROOT), str(tmp_path / "o"), 6)
    spans = []
    for path in glob.glob(str(tmp_path / "o" / "*.parquet")):
        days = pq.read_table(path, columns=["OrderDate"])["OrderDate"].to_pylist()
        spans.append((min(days), max(days)))
    spans.sort()
    assert len(spans) == 6
    assert all(before[1] <= after[0] for before, after in zip(spans, spans[1:]))


def test_unknown_table_names_are_refused(spark):
    with pytest.raises(ValueError):
        Tables({"bookz": None})
    with pytest.raises(AttributeError):
        Tables({}).books


def test_scratch_uses_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_root(spark) == folder.rstrip("/")
    saved = Scratch(spark, "job").save(spark.range(5), "numbers")
    assert saved.count() == 5 and saved.inputFiles()[0].replace("file://", "").startswith(folder)


def test_lookup_matches_a_plain_left_join(spark):
    schema = S._struct("OrderID long, PromotionID long, CustomerID long")
    facts = frame(spark, schema, *({"OrderID": i, "PromotionID": i % 3 or None, "CustomerID": i % 2}
                                   for i in range(12)), {"OrderID": 99, "PromotionID": 8, "CustomerID": 0})
    dim = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "PromotionID long, CustomerID long, v string")
    got = lookup(facts, dim, "PromotionID", -1 - F.col("OrderID"), "CustomerID")
    plain = facts.join(dim, ["PromotionID", "CustomerID"], "left")
    columns = ("OrderID", "PromotionID", "CustomerID", "v")
    assert sorted(rows(got, *columns), key=str) == sorted(rows(plain, *columns), key=str)


REQUEST_TEXTS = {
    1: ('{"OrderID":1,"CustomerID":2,"items":[{"BookID":1,"Quantity":2,"Price":3.5}],"more":true}', None),
    2: (None, "no_text"), 3: ("  ", "no_text"), 4: ("{oops", "malformed"), 5: ("[1,2]", "no_object"), 6: ("7", "no_object"),
    7: ('{"OrderID":"x","CustomerID":2,"items":[{"BookID":1}]}', "wrong_type"),
    8: ('{"OrderID":1,"CustomerID":2,"items":[{"BookID":1,"Quantity":"two"}]}', "wrong_type"),
    9: ('{"CustomerID":2,"items":[{"BookID":1}]}', "missing_OrderID"), 10: ('{"OrderID":1,"CustomerID":2}', "missing_items"),
    11: ('{"OrderID":1,"CustomerID":2,"items":null}', "missing_items"), 12: ('{"OrderID":1,"CustomerID":2,"items":[]}', "no_items"),
    13: ('{"OrderID":1,"CustomerID":2,"items":{"BookID":1}}', "wrong_type"),
}


def test_request_texts_are_read_or_refused_with_a_reason(spark, tmp_path):
    texts = spark.createDataFrame([(k, t) for k, (t, _) in REQUEST_TEXTS.items()], "n int, Text string")
    judged = R.read_texts(texts, "Text", S.ORDER_REQUEST, ("OrderID", "CustomerID", "items"))
    assert dict(rows(judged, "n", "Reason")) == {k: reason for k, (_, reason) in REQUEST_TEXTS.items()}
    assert judged.filter("Reason IS NOT NULL AND Parsed IS NOT NULL").count() == 0
    R.write_read(judged, str(tmp_path / "good"), str(tmp_path / "bad"))
    good = spark.read.schema(S.ORDER_REQUEST).parquet(str(tmp_path / "good"))
    assert rows(good, "OrderID", "CustomerID") == [(1, 2)] and good.first().asDict(True)["items"][0]["Quantity"] == 2
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert dict(rows(bad, "n", "Reason")) == {k: r for k, (_, r) in REQUEST_TEXTS.items() if r}
    assert dict(rows(bad, "n", "Text"))[4] == "{oops"
    assert R.read_texts(texts.limit(0), "Text", S.ORDER_REQUEST, ("items",)).count() == 0
