import datetime as dt

from shop_frames import one, rows

from ledgerlane.plans import dashboard as D
from ledgerlane.plans import revenue as R

NOW = dt.datetime(2024, 6, 30, 12)


def order(number, day, amount=100, customer=1):
    return {"OrderID": number, "CustomerID": customer, "OrderDate": day, "TotalAmount": amount}


def book(number, stock=10, price=10, genre="Novel", supplier=1, title=None):
    return {"BookID": number, "Title": title or f"Book {number}", "Author": "A", "Genre": genre,
            "Price": price, "Stock": stock, "SupplierID": supplier}


def line(number, item, quantity=1, price=10):
    return {"OrderID": number, "BookID": item, "Quantity": quantity, "Price": price}


def test_empty_shop_gives_zeros_and_no_rows(shop):
    t = shop()
    assert set(one(D.overview(t, NOW)).values()) == {0}
    assert set(one(D.inventory(t)).values()) == {0}
    assert set(one(D.new_books(t)).values()) == {0}
    assert set(one(R.summary(t, NOW)).values()) == {0}
    assert set(one(D.low_stock_share(t)).values()) == {0}
    assert [r[2:] for r in rows(D.order_recency(t, NOW))] == [(0, 0.0)] * 4
    advice = one(D.insights(t, NOW))
    assert (advice["StockAdvice"], advice["CustomerAdvice"], advice["SalesAdvice"]) == (
        "stable", "market", "improve")
    for report in (D.monthly, D.customer_growth, D.sales_trends, D.sales_chart, R.weekly):
        assert rows(report(t, NOW)) == []
    for report in (D.top_books, D.top_customers, D.low_stock, D.genres, D.suppliers, D.recent_orders):
        assert rows(report(t)) == []


def test_boundary_day_is_out_future_orders_count(shop):
    t = shop(orders=[order(1, "2024-05-31"), order(2, "2024-06-01"), order(3, "2024-07-15")])
    got = one(D.overview(t, NOW))
    assert (got["OrdersThisMonth"], got["RevenueThisMonth"]) == (2, 200.0)
    assert one(D.overview(t, dt.datetime(2024, 6, 30)))["OrdersThisMonth"] == 3


def test_recency_buckets_overlap(shop):
    t = shop(orders=[order(1, "2024-06-30"), order(2, "2024-06-25"), order(3, "2024-06-10"),
                     order(4, "2020-01-01")])
    assert rows(D.order_recency(t, NOW), "Code", "Count", "TotalValue") == [
        ("all", 4, 400.0), ("last_30_days", 3, 300.0), ("last_7_days", 2, 200.0), ("today", 1, 100.0)]


def test_monthly_keeps_the_newest_twelve_of_thirteen_months(shop):
    days = [f"2023-{m:02d}-30" for m in range(6, 13)] + [f"2024-{m:02d}-15" for m in range(1, 7)]
    t = shop(orders=[order(i, d) for i, d in enumerate(["2023-07-01", *days[1:]])] + [order(99, "2023-06-30")])
    midnight = dt.datetime(2024, 6, 30)
    months = [r[0] for r in rows(D.monthly(t, midnight), "Month")]
    assert len(months) == 12 and months[0] == "2024-06" and months[-1] == "2023-07"
    assert len(rows(D.customer_growth(t, midnight))) == 13


def test_weeks_carry_first_and_last_order_day(shop):
    t = shop(orders=[order(1, "2024-06-25"), order(2, "2024-06-27"), order(3, "2024-06-19")])
    assert rows(R.weekly(t, NOW), "WeekNumber", "WeekStart", "WeekEnd", "OrderCount") == [
        (202426, "2024-06-25", "2024-06-27", 2), (202425, "2024-06-19", "2024-06-19", 1)]


def test_unsold_books_rank_last_and_ties_go_by_key(shop):
    t = shop(books=[book(1), book(2), book(3)], order_details=[line(1, 3, 2), line(2, 3, 1)])
    assert rows(D.ranked_books(t, 3), "BookID", "TotalSold", "TotalRevenue", "Rank") == [
        (3, 3, 30.0, 1), (1, 0, 0.0, 2), (2, 0, 0.0, 3)]


def test_customers_without_orders_are_listed(shop):
    t = shop(customers=[{"CustomerID": 1, "Name": "A"}, {"CustomerID": 2, "Name": "B"}],
             orders=[order(1, "2024-01-01", 50, 2)])
    assert rows(D.ranked_customers(t), "CustomerID", "OrderCount", "TotalSpent", "LastOrderDate", "Rank") == [
        (2, 1, 50.0, dt.date(2024, 1, 1), 1), (1, 0, 0.0, None, 2)]


def test_genre_counts_books_per_line_and_exactly(shop):
    t = shop(books=[book(1, 7), book(2, 5), book(3, 1, genre=None)],
             order_details=[line(1, 1), line(2, 1), line(3, 1, 4)])
    assert sorted(rows(D.genres(t)), key=str) == [("Novel", 4, 26, 6, 60.0), (None, 1, 1, 0, 0.0)]
    assert sorted(rows(D.genres_exact(t)), key=str) == [("Novel", 2, 12, 6, 60.0), (None, 1, 1, 0, 0.0)]


def test_supplier_report_with_idle_supplier(shop):
    t = shop(suppliers=[{"SupplierID": 1, "Name": "S"}, {"SupplierID": 2, "Name": "T"}],
             books=[book(1, 7), book(2, 5, supplier=None)], order_details=[line(1, 1), line(2, 1)])
    columns = ("SupplierID", "BookCount", "TotalStock", "InventoryValue", "TotalSold", "TotalRevenue")
    assert sorted(rows(D.suppliers(t), *columns)) == [(1, 2, 14, 140.0, 2, 20.0), (2, 0, 0, 0.0, 0, 0.0)]
    assert sorted(rows(D.suppliers_exact(t), *columns)) == [(1, 1, 7, 70.0, 2, 20.0), (2, 0, 0, 0.0, 0, 0.0)]


def test_inventory_levels(shop):
    t = shop(books=[book(1, 0), book(2, 5, 2), book(3, 20), book(4, 21)])
    got = one(D.inventory(t))
    assert (got["LowStockCount"], got["OutOfStockCount"], got["HighStockCount"]) == (2, 1, 1)
    assert got["LowStockValue"] == 10.0 and got["AveragePrice"] == 8.0
    assert one(D.low_stock_share(t))["LowStockPercent"] == 50


def test_low_stock_without_supplier_and_null_stock(shop):
    t = shop(books=[book(1, 0, supplier=9), book(2, 3, supplier=None), book(3, None)])
    assert rows(D.low_stock(t), "BookID", "SupplierName") == [(1, None), (2, None)]


def test_new_books_are_the_last_ten_numbers(shop):
    t = shop(books=[book(1), book(11), book(12, 0), book(21)])
    got = one(D.new_books(t))
    assert (got["TotalNewBooks"], got["AvailableBooks"], got["OutOfStockBooks"]) == (2, 1, 1)


def test_recent_orders_with_unknown_customer_and_no_lines(shop):
    t = shop(orders=[order(1, "2024-06-01", customer=7), order(2, "2024-06-01"), order(3, "2024-05-01")],
             customers=[{"CustomerID": 1, "Name": "A", "Email": "a@b.c"}],
             order_details=[line(2, 1), line(2, 2)])
    assert rows(D.recent_orders(t, 2), "OrderID", "CustomerName", "ItemCount") == [(2, "A", 2), (1, None, 0)]


def test_growth_exact_counts_first_orders_only(shop):
    t = shop(orders=[order(1, "2020-01-01"), order(2, "2024-06-01"), order(3, "2024-06-02", customer=2),
                     order(4, "2024-05-02", customer=2)])
    assert dict(rows(D.customer_growth(t, NOW), "Month", "NewCustomers")) == {"2024-06": 2, "2024-05": 1}
    assert dict(rows(D.customer_growth_exact(t, NOW), "Month", "NewCustomers")) == {"2024-06": 0, "2024-05": 1}


def test_month_and_day_buckets_sum_to_the_same(shop):
    t = shop(orders=[order(i, f"2024-06-{i + 1:02d}", 10 * i) for i in range(1, 25)])
    months = rows(D.sales_chart(t, NOW), "OrderCount", "Revenue")
    days = rows(D.sales_chart(t, NOW, "day"), "OrderCount", "Revenue")
    assert [sum(c) for c in zip(*months)] == [sum(c) for c in zip(*days)]


def test_dashboard_sections_and_export(shop, tmp_path, spark):
    t = shop(orders=[order(1, "2024-06-25")], books=[book(1, 3)], order_details=[line(1, 1)],
             customers=[{"CustomerID": 1, "Name": "A"}], suppliers=[{"SupplierID": 1, "Name": "S"}])
    assert len(R.full_dashboard(t, NOW)) == 16
    with R.shared_scans(t) as shared:
        kept = {name: rows(df) for name, df in R.full_dashboard(shared, NOW).items()}
    assert kept == {name: rows(df) for name, df in R.full_dashboard(t, NOW).items()}
    R.write_json(R.export_report(t, NOW), str(tmp_path))
    back = spark.read.json(str(tmp_path / "topBooks")).collect()
    assert [(r.BookID, r.TotalSold) for r in back] == [(1, 1)]
    assert {r.Section for r in R.dashboard_document(t, NOW).collect()} == set(kept)
    assert len(rows(R.top_views(t, NOW)["topBooks"])) == 1
