import datetime as dt

import pytest
from shop_frames import one, rows

from ledgerlane.plans import catalog, orders, parties, payments
from ledgerlane.plans import promotions as P
from ledgerlane.sources import seeds

BOOKS = [
    {"BookID": 1, "Title": "Đường xưa", "Author": "Nguyễn", "Genre": "Thơ", "Stock": 3, "SupplierID": 1},
    {"BookID": 2, "Title": "100% cotton", "Author": "B_C", "Genre": None, "Stock": 0, "SupplierID": 9},
    {"BookID": 3, "Title": "cotton 1000", "Author": "BxC", "Genre": "Craft", "Stock": 20, "SupplierID": None},
]
SUPPLIERS = [{"SupplierID": 1, "Name": "Kim", "Phone": "0123456789"}, {"SupplierID": 2, "Name": "Lan"}]


def ids(df, column="BookID"):
    return [r[0] for r in df.select(column).collect()]


@pytest.mark.parametrize("term, found", [
    ("COTTON", [3, 2]), ("100%c", [2]), ("b_c", [3, 2]), ("craft", [3]), ("", [3, 2, 1]), ("zzz", []),
])
def test_search_wildcards_and_case(shop, term, found):
    t = shop(books=BOOKS, suppliers=SUPPLIERS)
    assert ids(catalog.book_search(t, term, ordered=True)) == found


def test_search_without_accents(shop):
    t = shop(books=BOOKS)
    assert ids(catalog.book_search(t, "duong", accent_insensitive=True)) == [1]
    assert ids(catalog.book_search(t, "duong")) == []
    assert ids(catalog.book_search(t, "100%", accent_insensitive=True)) == [2]


def test_typeahead_is_literal_and_limited(shop):
    t = shop(books=BOOKS + [{"BookID": i, "Title": "cotton"} for i in range(10, 30)])
    assert ids(catalog.book_typeahead(t, "0% C")) == [2]
    assert ids(catalog.book_typeahead(t, "Cotton")) == [2, 3, *range(10, 18)]
    assert ids(catalog.book_typeahead(t, "  ")) == []


def test_book_lists_keep_books_without_supplier(shop, spark):
    t = shop(books=BOOKS, suppliers=SUPPLIERS)
    assert rows(catalog.book_list(t, ordered=True), "BookID", "SupplierName") == [
        (3, None), (2, None), (1, "Kim")]
    assert ids(catalog.book_low_stock(t, ordered=True)) == [2, 1]
    keys = spark.createDataFrame([(1,), (3,), (77,), (1,)], "BookID long")
    assert sorted(ids(catalog.book_lookup(t, keys))) == [1, 3]
    assert rows(catalog.stock_levels(t), "StockStatus", "StockTier") == [
        ("low", "low"), ("out", "low"), ("ok", "high")]


def test_supplier_totals(shop, spark):
    t = shop(books=BOOKS[:1] + [{**BOOKS[2], "SupplierID": 1}], suppliers=SUPPLIERS)
    assert rows(parties.supplier_list(t, ordered=True), "SupplierID", "TotalBooks", "TotalStock") == [
        (2, 0, 0), (1, 2, 23)]
    assert rows(parties.supplier_top(t, 1), "SupplierID") == [(1,)]
    assert list(one(parties.supplier_stats(t)).values()) == [3, 2, 23]
    assert list(one(parties.supplier_stats_exact(t)).values()) == [2, 1, 23]
    assert ids(parties.supplier_search(t, "k_m"), "SupplierID") == [1]
    keys = spark.createDataFrame([(1,)], "SupplierID long")
    assert ids(parties.supplier_books(t, keys, ordered=True)) == [3, 1]
    assert ids(parties.supplier_lookup(t, keys), "SupplierID") == [1]


ORDERS = [
    {"OrderID": 1, "CustomerID": 1, "OrderDate": "2024-01-01", "TotalAmount": 10, "PaymentMethodID": 1,
     "PaymentStatus": "paid", "PromotionID": 2},
    {"OrderID": 2, "CustomerID": 1, "OrderDate": "2024-01-31", "TotalAmount": 20, "PaymentMethodID": None,
     "PaymentStatus": "paid"},
    {"OrderID": 3, "CustomerID": 8, "OrderDate": "2024-02-01", "TotalAmount": 30, "PaymentMethodID": 1,
     "PaymentStatus": "pending"},
]
LINES = [{"OrderID": 1, "BookID": 1, "Quantity": 4, "Price": 2.5}, {"OrderID": 1, "BookID": 2, "Quantity": 0, "Price": 1},
         {"OrderID": 3, "BookID": 77, "Quantity": 1, "Price": 3}]
CUSTOMERS = [{"CustomerID": 1, "Name": "An", "Email": "an@x.vn", "Phone": "0901234567"},
             {"CustomerID": 2, "Name": "Binh", "Email": None}]


@pytest.fixture
def desk(shop, spark):
    t = shop(orders=ORDERS, order_details=LINES, customers=CUSTOMERS, books=BOOKS)
    return t.replace(payment_methods=seeds.payment_methods(spark), promotions=seeds.promotions(spark),
                     promotion_types=seeds.promotion_types(spark))


def test_order_lists(desk, spark):
    assert rows(orders.order_list(desk, ordered=True), "OrderID", "CustomerName", "TotalItems",
                "PaymentMethodName", "PromotionCode") == [
        (3, None, 1, "Cash", None), (2, "An", 0, None, None), (1, "An", 2, "Cash", "SAVE20")]
    between = orders.orders_between(desk, dt.date(2024, 1, 1), dt.date(2024, 1, 31), ordered=True)
    assert ids(between, "OrderID") == [2, 1]
    keys = spark.createDataFrame([(1,), (3,)], "OrderID long")
    assert sorted(rows(orders.order_details(desk, keys), "BookID", "Title")) == [
        (1, "Đường xưa"), (2, "100% cotton"), (77, None)]
    assert sorted(ids(orders.order_lookup(desk, keys), "OrderID")) == [1, 3]
    assert one(orders.order_stats(desk)) == {
        "TotalOrders": 3, "TotalRevenue": 60.0, "AverageOrderValue": 20.0, "UniqueCustomers": 2}
    who = spark.createDataFrame([(1,)], "CustomerID long")
    assert rows(parties.customer_orders(desk, who, ordered=True), "OrderID", "TotalItems") == [(2, 0), (1, 2)]


def test_order_amounts(desk):
    assert sorted(rows(orders.order_totals(desk), "OrderID", "SubTotal", "Total")) == [
        (1, 10.0, 10.0), (2, 0.0, 0.0), (3, 3.0, 3.0)]
    assert sorted(rows(orders.line_totals(desk), "BookID", "LineTotal")) == [(1, 10.0), (2, 0.0), (77, 3.0)]
    assert sorted(rows(orders.stock_shortfall(desk), "BookID", "Quantity", "Stock")) == [(1, 4, 3), (77, 1, 0)]


def test_statistics_over_no_orders_have_no_average(shop):
    assert one(orders.order_stats(shop())) == {
        "TotalOrders": 0, "TotalRevenue": 0.0, "AverageOrderValue": None, "UniqueCustomers": 0}


def test_customer_lists(desk, spark):
    assert rows(parties.customer_list(desk, ordered=True), "CustomerID", "TotalOrders", "TotalSpent") == [
        (2, 0, 0.0), (1, 2, 30.0)]
    assert ids(parties.customer_search(desk, "0901"), "CustomerID") == [1]
    assert ids(parties.customer_search(desk, "x.vn"), "CustomerID") == [1]
    assert ids(parties.customer_top(desk, 1), "CustomerID") == [1]
    assert ids(P.new_customers(desk), "CustomerID") == [2]
    assert ids(P.loyal_customers(desk, 2), "CustomerID") == [1]
    assert ids(P.loyal_customers(desk), "CustomerID") == []
    keys = spark.createDataFrame([(2,)], "CustomerID long")
    assert ids(parties.customer_lookup(desk, keys), "CustomerID") == [2]


def test_payment_statistics(desk):
    assert rows(payments.payment_stats(desk)) == [("Cash", 2, 40.0, 20.0)]
    january = (dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    assert rows(payments.payment_stats(desk, *january)) == [("Cash", 1, 10.0, 10.0)]
    assert rows(payments.payment_stats(desk, january[0], None)) == [("Cash", 2, 40.0, 20.0)]
    usage = rows(payments.method_usage(desk))
    assert usage[0] == ("Cash", 1, 10.0) and usage[1] == ("Bank Transfer", 0, None) and len(usage) == 5
    assert rows(payments.orders_by_status(desk, "paid", ordered=True), "OrderID", "MethodName") == [
        (2, None), (1, "Cash")]
    assert ids(payments.orders_by_status(desk, "pending"), "OrderID") == []  # unknown customer


def test_promotion_lists(desk):
    shown = rows(P.promotion_list(desk, ordered=True), "PromotionCode", "UsageLimitDisplay")
    assert shown == [("WELCOME10", "100"), ("SAVE20", "50"), ("BOOKSALE", "200"), ("LOYALTY5", "∞")]
    assert len(rows(P.promotion_list(desk, "0"))) == 4
    assert ids(P.promotion_list(desk, "văn học"), "PromotionCode") == ["BOOKSALE"]
    active = P.active_promotions(desk, dt.datetime(2024, 12, 31, 23), ordered=True)
    assert rows(active, "PromotionID", "TypeName")[0] == (1, "Product Discount")
    assert rows(P.active_promotions(desk, dt.datetime(2025, 1, 1))) == []
