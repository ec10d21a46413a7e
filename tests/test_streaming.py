import datetime as dt
import json
from pathlib import Path

import pytest
from shop_frames import frame, rows
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane import schema as S
from ledgerlane.plans import constraints, state, validation
from ledgerlane.plans.ordering import take_orders
from ledgerlane.session import Scratch
from ledgerlane.sources import requests as R
from ledgerlane.streaming import orders as intake
from ledgerlane.streaming import sales
from ledgerlane.streaming.replay import cuts, laid_out, put_pieces, replay
from test_ordering import setting
from test_state import EVENT

NOW = dt.datetime(2024, 6, 15, 12)
SALE = S._struct("ts timestamp, CustomerID long, Amount money")


def put(df, folder, number):
    """One file per batch, named and dated in order."""
    df.coalesce(1).write.mode("append").parquet(f"{folder}/part={number}")


def batches(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def work_off(df, log, name, mode, progress):
    query = intake.run(df, lambda b, n: log.write(name, n, b), progress, mode)
    query.awaitTermination()
    return query.lastProgress["batchId"]


@pytest.fixture
def sold(spark, tmp_path):
    hours = [(d, h) for d in range(1, 8) for h in (1, 9, 23)]
    data = [{"ts": f"2024-01-{d:02d} {h:02d}:00:00", "CustomerID": h, "Amount": d} for d, h in hours]
    for i in range(0, len(data), 7):
        put(frame(spark, SALE, *data[i:i + 7]), tmp_path / "sales", i)
    return tmp_path


def test_sales_in_order(spark, sold):
    stream = batches(spark, sold / "sales", SALE)
    log = intake.BatchLog(spark, str(sold / "log"))
    trends = sales.daily_sales(stream)
    last = work_off(trends, log, "complete", "complete", str(sold / "c1"))
    full = sorted(rows(log.read_one("complete", trends.schema, last)))
    assert full == [(f"2024-01-{d:02d}", 3, 3.0 * d, float(d), 3) for d in range(1, 8)]
    last = work_off(trends, log, "append", "append", str(sold / "c2"))
    closed = sorted(rows(log.read("append", trends.schema, -1, last + 1).drop("batch")))
    assert closed == full[:len(closed)] and 4 <= len(closed) < 7  # the last days stay open


def test_sales_out_of_order_lose_late_rows(spark, tmp_path):
    days = [5, 6, 9, 1]
    for i, d in enumerate(days):
        put(frame(spark, SALE, {"ts": f"2024-01-{d:02d} 10:00:00", "CustomerID": 1, "Amount": 1}), tmp_path / "s", i)
    log = intake.BatchLog(spark, str(tmp_path / "log"))
    trends = sales.daily_sales(batches(spark, tmp_path / "s", SALE))
    last = work_off(trends, log, "append", "append", str(tmp_path / "c"))
    assert "2024-01-01" not in [r[0] for r in rows(log.read("append", trends.schema, -1, last + 1))]


def test_buyers_are_counted_once_per_day(spark, sold):
    log = intake.BatchLog(spark, str(sold / "log"))
    pairs = sales.daily_buyers(batches(spark, sold / "sales", SALE).unionByName(
        batches(spark, sold / "sales", SALE)))
    last = work_off(pairs, log, "pairs", "append", str(sold / "c"))
    logged = log.read("pairs", pairs.schema, -1, last + 1)
    per_day = logged.groupBy("Day").agg(F.count("*").alias("n"))
    assert [r.n for r in per_day.collect()] == [3] * 7


ITEM = {"BookID": 1, "Quantity": 1, "Price": 2}
REQUESTS = [
    {"OrderID": 1, "CustomerID": 1, "OrderDate": "2024-06-15", "TotalAmount": 2, "items": [ITEM]},
    {"OrderID": 2, "CustomerID": 1, "OrderDate": "2024-06-15", "TotalAmount": 2, "items": []},
    {"OrderID": 1, "CustomerID": 1, "OrderDate": "2024-06-15", "TotalAmount": 2, "items": [ITEM]},
    {"OrderID": 3, "CustomerID": 1, "OrderDate": "", "TotalAmount": 2, "items": [ITEM]},
]


def test_request_stream_is_judged_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, request in enumerate(REQUESTS):
        line = json.dumps({"ArrivedAt": f"2024-06-15T10:0{i}:00Z", **request})
        (source / f"{i}.json").write_text(line + "\n")
    judged = intake.judged_orders(R.stream_requests(spark, str(source)))
    log = intake.BatchLog(spark, str(tmp_path / "log"))
    last = work_off(judged, log, "judged", "append", str(tmp_path / "c"))
    got = log.read("judged", judged.schema, -1, last + 1)
    assert sorted(rows(got, "OrderID", "Reason"), key=str) == [(1, None), (2, "no_items"), (3, "date_missing")]
    batch = validation.validate_nested_orders(R.read_requests(spark, str(source)).dropDuplicates(["OrderID"]))
    assert sorted(rows(got, "OrderID", "Reason"), key=str) == sorted(rows(batch, "OrderID", "Reason"), key=str)


def test_items_from_text(spark):
    df = spark.createDataFrame([('[{"BookID":1,"Quantity":2,"Price":3.5}]',), ("oops",)], "t string")
    got = df.select(R.items_from_text("t").alias("i")).select(F.col("i.BookID"), F.col("i.Quantity")).collect()
    assert [tuple(r) for r in got] == [([1], [2]), (None, None)]


def test_orders_over_batches_equal_one_batch(spark, shop, tmp_path):
    orders = [(n, n % 3, 1 if n % 2 else None, [(1, 2), (2, n % 4 + 1)]) for n in range(1, 13)]
    t, headers, lines = setting(spark, shop, {1: 14, 2: 11}, {1: 2}, orders)
    once = take_orders(t, headers, lines, NOW, Scratch(spark, "test"))
    nested = headers.join(
        lines.groupBy("OrderID").agg(F.collect_list(F.struct("BookID", "Quantity", "Price")).alias("items")), "OrderID")
    nested = nested.select(*S.ORDER_REQUEST.fieldNames())
    for i in range(4):
        put(nested.filter(F.col("OrderID").between(3 * i + 1, 3 * i + 3)), tmp_path / "in", i)
    log = intake.BatchLog(spark, str(tmp_path / "log"))
    step = intake.order_intake(log, t, NOW, snapshot_every=2)
    query = intake.run(batches(spark, tmp_path / "in", S.ORDER_REQUEST), step, str(tmp_path / "c"))
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    assert last == 3
    decided = log.read("decisions", once.decisions.schema, -1, 99)
    short = lambda df: sorted(rows(df, "OrderID", "Accepted"))
    assert short(decided) == short(once.decisions)
    expected = sorted(rows(once.books, "BookID", "Stock", "OutputQuantity"))

    def books_now():
        done = log.read("order_details", t.order_details.schema, 2, 99)
        base = log.read_one("books", t.books.schema, 2)
        return sorted(rows(state.move_stock(base, done, 1), "BookID", "Stock", "OutputQuantity"))

    assert books_now() == expected
    step(nested.filter(F.col("OrderID") >= 10), 3)  # a repeated batch changes nothing
    assert books_now() == expected
    assert short(log.read("decisions", once.decisions.schema, -1, 99)) == short(once.decisions)


def test_payments_over_batches_equal_batch(spark, shop, tmp_path):
    statuses = ["paid", "failed", "refunded", "pending"]
    events = [{"EventID": i, "OrderID": i % 5, "At": f"2024-01-{i % 9 + 1:02d}", "Status": statuses[i % 4],
               "PaymentMethodID": i % 3 or None, "TransactionID": f"t{i}"} for i in range(40)]
    t = shop(orders=[{"OrderID": i, "PaymentStatus": "pending", "TransactionID": "old"} for i in range(7)])
    for i in range(0, 40, 10):
        put(frame(spark, EVENT, *events[i:i + 10]), tmp_path / "in", i)
    log = intake.BatchLog(spark, str(tmp_path / "log"))
    folds = intake.folded_payments(batches(spark, tmp_path / "in", EVENT))
    query = intake.run(folds, intake.payment_intake(log), str(tmp_path / "c"), "update")
    query.awaitTermination()
    now = intake.orders_with_payments(log, t.orders, folds.schema, query.lastProgress["batchId"])
    batch = state.apply_payments(t.orders, frame(spark, EVENT, *events))
    assert sorted(rows(now), key=str) == sorted(rows(batch), key=str)


def test_numbers_are_decided_once_over_batches_crashes_and_repeats(spark, shop, tmp_path):
    orders = [(n, n % 2 + 1, None, [(1, 2)]) for n in range(1, 9)] + [(50, 1, None, [(1, 1)]), (9, 77, None, [(1, 1)])]
    t, headers, lines = setting(spark, shop, {1: 11}, {}, orders)
    t = t.replace(customers=frame(spark, S.CUSTOMERS, {"CustomerID": 1}, {"CustomerID": 2}),
                  orders=frame(spark, S.ORDERS, {"OrderID": 50}))
    headers, lines = headers.withColumn("Delivery", F.lit(1)), lines.withColumn("Delivery", F.lit(1))
    repeats = F.col("OrderID").isin(1, 2, 8)
    every = headers.unionByName(headers.filter(repeats).withColumn("Delivery", F.lit(2)))
    lines = lines.unionByName(lines.filter(repeats).withColumn("Delivery", F.lit(2)))
    whole, _ = constraints.take_once(t, every, lines, NOW, Scratch(spark, "test"))

    log = intake.BatchLog(spark, str(tmp_path / "log"))
    step = intake.exact_intake(log, t, NOW, intake.with_stored_lines(lines), snapshot_every=2)
    arriving = every.withColumn("turn", F.col("OrderID") + F.col("Delivery") * 1000)
    batches_of = [arriving.filter(F.col("turn").between(a, b)).drop("turn") for a, b in (
        (1001, 1003), (1004, 1050), (2001, 2001), (2002, 2999))]
    for number, batch in enumerate(batches_of):
        step(batch, number)
        if number == 1:  # a crash after the writes: the batch comes again
            step(batch, number)
    decided = lambda df: sorted(rows(df, "OrderID", "Delivery", "Accepted", "Reason"), key=str)
    logged = log.read("decisions", intake.DELIVERED, -1, 99)
    assert decided(logged) == decided(whole)
    assert [r for r in decided(logged) if r[1] == 2] == [(n, 2, False, "repeated_request") for n in (1, 2, 8)]
    assert (50, 1, False, "order_exists") in decided(logged) and (9, 1, False, "unknown_customer") in decided(logged)
    sold = log.read("order_details", t.order_details.schema, -1, 99)
    assert sold.agg(F.sum("Quantity")).first()[0] == 10 and sold.select("OrderID").distinct().count() == 5


def test_reasons_do_not_depend_on_how_requests_are_cut_into_batches(spark, shop, tmp_path):
    orders = [(n, c, 1, [(1, 1)]) for n, c in enumerate((2, 3, 2, 1, 3, 4, 5), 1)] + [(8, 9, 2, [(1, 1)])]
    t, headers, lines = setting(spark, shop, {1: 50}, {1: 4, 2: 0}, orders)
    t = t.replace(customers=frame(spark, S.CUSTOMERS, *({"CustomerID": n} for n in range(10))))
    headers, lines = headers.withColumn("Delivery", F.lit(1)), lines.withColumn("Delivery", F.lit(1))
    whole, _ = constraints.take_once(t, headers, lines, NOW, Scratch(spark, "test"))
    decided = lambda df: sorted(rows(df, "OrderID", "Accepted", "Reason"), key=str)
    assert {r[2] for r in decided(whole)} == {None, "already_used", "promotion_exhausted", "promotion_refused"}
    exact, plain = (intake.BatchLog(spark, str(tmp_path / name)) for name in ("exact", "plain"))
    once = intake.exact_intake(exact, t, NOW, intake.with_stored_lines(lines), snapshot_every=2)
    serve = intake.order_intake(plain, t, NOW, snapshot_every=2, split=intake.with_stored_lines(lines.drop("Delivery")))
    for number, last in enumerate((2, 4, 8)):
        batch = headers.filter(F.col("OrderID").between((1, 3, 5)[number], last))
        once(batch, number)
        serve(batch.drop("Delivery"), number)
    assert decided(exact.read("decisions", intake.DELIVERED, -1, 99)) == decided(whole)
    assert decided(plain.read("decisions", intake.DELIVERED, -1, 99)) == decided(whole)


def test_replay_stops_and_goes_on_in_order(spark, tmp_path):
    data = spark.range(95).select(F.col("id").cast("long").alias("k"))
    seen = []
    start = lambda stream, progress: intake.run(
        stream, lambda df, n: seen.append((n, sorted(r.k for r in df.collect()))), progress)
    last = replay(spark, data, "k", str(tmp_path), start, pieces=10)
    assert last == 9 and [n for n, _ in seen] == list(range(10))
    assert [k for _, own in seen for k in own] == list(range(95))


def test_pieces_are_cut_at_exact_quantiles_of_ranges(spark, tmp_path):
    values = [None, float("nan"), float("-inf"), float("inf"), -2.5, *[7.0] * 40, *(float(n % 31) for n in range(100))]
    data = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, k double").repartition(5)
    laid = laid_out(data, "k", str(tmp_path / "laid"))
    assert cuts(laid, 1) == []
    for pieces in (2, 7, 10, 400):
        assert cuts(laid, pieces) == data.approxQuantile("k", [k / pieces for k in range(1, pieces)], 0.0)
    ends = cuts(laid, 10)
    put_pieces(laid, ends, 10, str(tmp_path / "in"), range(10))
    arrived = [spark.read.schema(data.schema).parquet(f"{tmp_path}/in/piece={k:06d}").collect() for k in range(10)]
    assert sorted(r.id for own in arrived for r in own) == list(range(1, len(values)))  # a row without a value never comes
    for k, own in enumerate(arrived):
        assert all((k == 0 or not r.k <= ends[k - 1]) and (k == 9 or r.k <= ends[k]) for r in own)
    assert cuts(laid_out(data.where("k IS NULL"), "k", str(tmp_path / "none")), 10) == []


def test_replay_holds_no_table_of_values_in_one_task(spark, tmp_path, monkeypatch):
    def refuse(*_):
        raise AssertionError("quantiles without error keep every value in the memory of one task")

    monkeypatch.setattr(DataFrame, "approxQuantile", refuse)
    monkeypatch.setattr(type(spark.range(1)), "approxQuantile", refuse)
    seen = []
    start = lambda stream, progress: intake.run(
        stream, lambda df, n: seen.append(sorted(r.k for r in df.collect())), progress)
    replay(spark, spark.range(40).select((-F.col("id")).alias("k")), "k", str(tmp_path), start, pieces=4)
    assert [k for own in seen for k in own] == list(range(-39, 1)) and [len(own) for own in seen] == [10] * 4
    laid = laid_out(spark.range(40), "id", str(tmp_path / "laid"))
    plan = laid.where("_at > 30.0")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(_at), GreaterThan(_at,30.0)]" in plan


def test_lines_are_sought_among_the_numbers_of_a_batch(spark, tmp_path):
    lines = spark.range(100).select(F.floor(F.col("id") / 2).alias("OrderID"), F.col("id").alias("BookID"))
    lines.write.parquet(str(tmp_path / "lines"))
    stored = spark.read.parquet(str(tmp_path / "lines"))
    split = intake.with_stored_lines(stored)

    def own(*numbers):
        return split(spark.createDataFrame([(n,) for n in numbers], "OrderID long"))[1]

    plan = own(9, 12, None, 9)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(OrderID,9), LessThanOrEqual(OrderID,12)" in plan
    assert sorted(rows(own(9, 12, None, 9))) == [(9, 18), (9, 19), (12, 24), (12, 25)]
    assert rows(own(None)) == rows(own()) == rows(own(77)) == []


def test_a_batch_leaves_its_logs_only(spark, shop, tmp_path):
    t, headers, lines = setting(spark, shop, {1: 9}, {}, [(1, 1, None, [(1, 1)]), (2, 1, None, [(1, 1)])])
    t = t.replace(customers=frame(spark, S.CUSTOMERS, {"CustomerID": 1}))
    headers, lines = headers.withColumn("Delivery", F.lit(1)), lines.withColumn("Delivery", F.lit(1))
    shared = Path(Scratch(spark, "any").path.removeprefix("file:")).parent
    before = set(shared.glob("intake-*"))
    log = intake.BatchLog(spark, str(tmp_path / "log"))
    intake.exact_intake(log, t, NOW, intake.with_stored_lines(lines))(headers, 0)
    assert set(shared.glob("intake-*")) == before
    assert log.read("decisions", intake.DELIVERED, -1, 1).where("Accepted").count() == 2
