import pytest
from shop_frames import frame, rows

from ledgerlane import schema as S
from ledgerlane.plans import validation as V


def reasons(judged):
    return [r[0] for r in rows(judged, "Reason")]


BOOK = {"Title": "T", "Author": "A", "Genre": "G", "Price": "1.50", "SupplierID": "1"}
BOOK_REQUEST = S._struct("Title string, Author string, Genre string, Price string, InputQuantity string, "
                         "OutputQuantity string, Stock string, SupplierID string")


@pytest.mark.parametrize("change, reason", [
    ({}, None), ({"Title": ""}, "title_missing"), ({"Title": "0"}, "title_missing"),
    ({"Title": " "}, None), ({"Author": None}, "author_missing"), ({"Genre": ""}, "genre_missing"),
    ({"Price": "0"}, "bad_price"), ({"Price": "-1"}, "bad_price"), ({"Price": "1,5"}, "bad_price"),
    ({"Price": None}, "bad_price"), ({"Price": "1e2"}, None), ({"Price": "NaN"}, "bad_price"),
    ({"InputQuantity": "-1"}, "bad_input_quantity"), ({"InputQuantity": "0"}, None),
    ({"OutputQuantity": "x"}, "bad_output_quantity"), ({"Stock": "-0.5"}, "bad_stock"),
    ({"SupplierID": "0"}, "supplier_missing"), ({"SupplierID": None}, "supplier_missing"),
    ({"Title": "", "Author": ""}, "title_missing"),
])
def test_books(spark, change, reason):
    assert reasons(V.validate_books(frame(spark, BOOK_REQUEST, {**BOOK, **change}))) == [reason]


@pytest.mark.parametrize("phone, reason", [
    ("123456789", "bad_phone"), ("1234567890", None), ("12345678901", None), ("123456789012", "bad_phone"),
    ("12345 67890", "bad_phone"), ("", "phone_missing"), (None, "phone_missing"), ("1234567890\n", None),  # "$" also stands before a final line end
])
def test_phones(spark, phone, reason):
    schema = S._struct("Name string, Email string, Address string, Phone string")
    df = frame(spark, schema, {"Name": "N", "Email": "a@b.vn", "Address": "X", "Phone": phone})
    assert reasons(V.validate_customers(df)) == [reason]
    assert reasons(V.validate_suppliers(df)) == [reason]


@pytest.mark.parametrize("email, reason", [
    ("a@b.c", None), ("a.b@c.d.e", None), ("a@b", "bad_email"), ("@b.c", "bad_email"), ("a b@c.d", "bad_email"),
    ("a@@b.c", "bad_email"), ("", "email_missing"), (None, "email_missing"), ("x" * 250 + "@b.vn", "bad_email"),
])
def test_emails(spark, email, reason):
    schema = S._struct("Name string, Email string, Phone string")
    df = frame(spark, schema, {"Name": "N", "Email": email, "Phone": "0123456789"})
    assert reasons(V.validate_customers(df)) == [reason]


PROMOTION = {"PromotionCode": "C", "PromotionName": "N", "DiscountType": "percentage", "DiscountValue": "10",
             "StartDate": "2024-02-01", "EndDate": "2024-02-29"}
PROMOTION_REQUEST = S._struct(", ".join(f"{c} string" for c in PROMOTION))


@pytest.mark.parametrize("change, reason", [
    ({}, None), ({"PromotionCode": "0"}, "code_missing"), ({"PromotionName": ""}, "name_missing"),
    ({"DiscountType": None}, "bad_type"), ({"DiscountType": "Percentage"}, "bad_type"),
    ({"DiscountValue": "0"}, "bad_value"), ({"DiscountValue": "100"}, None),
    ({"DiscountValue": "100.01"}, "percentage_above_100"),
    ({"DiscountValue": "200", "DiscountType": "fixed_amount"}, None),
    ({"StartDate": None}, "dates_missing"), ({"StartDate": "2024-2-3"}, "bad_start_format"),
    ({"EndDate": "29.02.2024"}, "bad_end_format"), ({"EndDate": "2024-02-30"}, "bad_end"),
    ({"StartDate": "2023-02-29"}, "bad_start"), ({"EndDate": "2024-02-01"}, "end_not_after_start"),
])
def test_promotions(spark, change, reason):
    df = frame(spark, PROMOTION_REQUEST, {**PROMOTION, **change})
    assert reasons(V.validate_promotions(df)) == [reason]


GOOD_ITEM = {"BookID": 1, "Quantity": 1, "Price": 1}
GOOD_ORDER = {"CustomerID": 1, "OrderDate": "2024-01-01", "TotalAmount": 5}


@pytest.mark.parametrize("change, items, reason", [
    ({}, [GOOD_ITEM], None),
    ({"CustomerID": 0}, [GOOD_ITEM], "customer_missing"),
    ({"CustomerID": None, "OrderDate": None}, [GOOD_ITEM], "customer_missing"),
    ({"OrderDate": ""}, [GOOD_ITEM], "date_missing"),
    ({"TotalAmount": 0}, [GOOD_ITEM], "bad_total"),
    ({"TotalAmount": None}, [], "bad_total"),
    ({}, [], "no_items"),
    ({}, None, "no_items"),
    ({}, [GOOD_ITEM, {"BookID": None, "Quantity": 0}], "item_without_book"),
    ({}, [{**GOOD_ITEM, "Price": 0}, {**GOOD_ITEM, "Quantity": 0}], "bad_item_price"),
    ({}, [GOOD_ITEM, {**GOOD_ITEM, "Quantity": -1, "Price": -1}], "bad_item_quantity"),
    ({}, [GOOD_ITEM, {"BookID": 1, "Quantity": 1}], "bad_item_price"),
])
def test_orders_flat_and_nested_agree(spark, change, items, reason):
    import decimal

    header = {**GOOD_ORDER, **change}
    total = header["TotalAmount"]
    nested = items if items is None else [
        (i.get("BookID"), i.get("Quantity"),
         None if i.get("Price") is None else decimal.Decimal(i["Price"])) for i in items]
    df = spark.createDataFrame(
        [(9, header["CustomerID"], header["OrderDate"], None, None,
          None if total is None else decimal.Decimal(total), nested)], S.ORDER_REQUEST)
    assert reasons(V.validate_orders(*V.explode_requests(df))) == [reason]
    assert reasons(V.validate_nested_orders(df)) == [reason]


def test_unique_values(spark):
    schema = S._struct("RequestID long, CustomerID long, Email string")
    stored = frame(spark, schema, {"CustomerID": 1, "Email": "a@x.vn"}, {"CustomerID": 2, "Email": "b@x.vn"},
                   {"CustomerID": 3, "Email": None})
    batch = frame(
        spark, schema,
        {"RequestID": 1, "CustomerID": 1, "Email": "A@x.vn"},  # keeps its own
        {"RequestID": 2, "CustomerID": None, "Email": "a@X.vn"},  # a new row may not take it
        {"RequestID": 3, "CustomerID": 1, "Email": "b@x.vn"},
        {"RequestID": 4, "CustomerID": None, "Email": "new@x.vn"},
        {"RequestID": 5, "CustomerID": 2, "Email": "NEW@x.vn"},
        {"RequestID": 6, "CustomerID": None, "Email": None},
        {"RequestID": 7, "CustomerID": None, "Email": None},
    )
    judged = V.unique_conflicts(batch, stored, "CustomerID", "Email", "RequestID")
    assert sorted(rows(judged, "RequestID", "Reason")) == [
        (1, None), (2, "Email_taken"), (3, "Email_taken"), (4, None), (5, "Email_repeated"), (6, None), (7, None)]
    assert V.accepted(judged).count() == 4 and V.rejected(judged).count() == 3


def test_delete_guard(spark, shop):
    t = shop(books=[{"BookID": 1}, {"BookID": 2}], order_details=[{"OrderID": 1, "BookID": 1}, {"OrderID": 2, "BookID": 7}])
    ids = spark.createDataFrame([(1,), (2,), (3,), (7,), (2,)], "BookID long")
    outcomes = V.delete_outcomes(ids, t.books, t.order_details, "BookID")
    assert sorted(rows(outcomes)) == [(1, "in_use"), (2, "deleted"), (3, "unknown"), (7, "in_use")]
    assert rows(V.delete_rows(t.books, outcomes, "BookID"), "BookID") == [(1,)]
