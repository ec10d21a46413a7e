"""Batches of incoming changes taken from the star schema's rows.

Every batch is a projection of a whole source table.  Faulty values are put in
by the value of a column, so all checks meet rows that fail them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane import schema as S
from ledgerlane.sources.star import orders, part_promotions, source

FAR = 1_000_000_000_000  # beyond every stored key


def _put(by: Column, faults: dict, value: Column) -> Column:
    """``value``, or the fault listed for the value of ``by``."""
    kind = None
    for key, fault in faults.items():
        fault = F.lit(fault).cast("string")
        kind = F.when(by == key, fault) if kind is None else kind.when(by == key, fault)
    return kind.otherwise(value.cast("string"))


def book_requests(spark: SparkSession, root: str) -> DataFrame:
    size = F.col("p_size")
    price = F.col("p_retailprice").cast(S.MONEY)
    return source(spark, root, "part").select(
        F.col("p_partkey").alias("BookID"),
        _put(size, {1: ""}, F.col("p_name")).alias("Title"),
        _put(size, {2: "0"}, F.col("p_brand")).alias("Author"),
        _put(size, {3: None}, F.col("p_type")).alias("Genre"),
        _put(size, {4: "abc", 5: "-1"}, price).alias("Price"),
        _put(size, {6: "-5", 11: None}, size).alias("InputQuantity"),
        _put(size, {7: "x"}, F.lit(None)).alias("OutputQuantity"),
        _put(size, {8: "-1"}, size).alias("Stock"),
        _put(size, {9: None, 10: "0"}, F.substring("p_brand", 7, 10)).alias("SupplierID"),
    )


def customer_requests(spark: SparkSession, root: str) -> DataFrame:
    nation = F.col("c_nationkey")
    segment = F.concat(F.lower("c_mktsegment"), F.lit(".example"))
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), segment)
    email = F.when(nation == 6, F.upper(email)).when(
        nation == 7, F.concat(F.lit("shared@"), segment)).otherwise(email)
    return source(spark, root, "customer").select(
        F.col("c_custkey").alias("RequestID"),
        F.when(nation != 6, F.col("c_custkey")).alias("CustomerID"),
        _put(nation, {0: ""}, F.col("c_name")).alias("Name"),
        _put(nation, {1: None, 2: "no-at-sign"}, email).alias("Email"),
        _put(nation, {3: "", 4: "12345", 5: "123456789012"}, F.col("c_custkey") + 10_000_000_000)
        .alias("Phone"),
    )


def supplier_requests(spark: SparkSession, root: str) -> DataFrame:
    nation = F.col("s_nationkey")
    return source(spark, root, "supplier").select(
        F.col("s_suppkey").alias("RequestID"),
        F.when(nation != 4, F.col("s_suppkey")).alias("SupplierID"),
        _put(nation, {0: None}, F.col("s_name")).alias("Name"),
        _put(nation, {1: ""}, F.concat(F.lit("Nation "), nation)).alias("Address"),
        _put(nation, {2: None, 3: "x123", 5: "0999999999"}, F.col("s_suppkey") + 20_000_000_000)
        .alias("Phone"),
    )


def promotion_requests(spark: SparkSession, root: str) -> DataFrame:
    size = F.col("p_size")
    number = F.col("p_partkey") + len(S.SEED_PROMOTIONS) + 1
    percentage = F.col("p_type").isin("ECONOMY", "PROMO", "SMALL")
    kind = F.when(percentage, "percentage").otherwise("fixed_amount")
    return source(spark, root, "part").select(
        F.col("p_partkey").alias("RequestID"),
        F.when(size != 20, number).alias("PromotionID"),
        _put(size, {1: "", 21: "SPRING"}, F.concat(F.lit("BOOK"), F.col("p_partkey")))
        .alias("PromotionCode"),
        _put(size, {2: None}, F.col("p_name")).alias("PromotionName"),
        _put(size, {3: "bogus"}, kind).alias("DiscountType"),
        _put(size, {4: "0", 5: "abc", 6: "150"}, size).alias("DiscountValue"),
        _put(size, {7: "", 8: "2024/01/01", 9: "2024-02-30"}, F.lit("2024-03-01")).alias("StartDate"),
        _put(size, {10: None, 11: "2024-2-3", 12: "2024-13-01", 13: "2024-03-01", 14: "2024-02-01"},
             F.lit("2024-12-31")).alias("EndDate"),
    )


def request_headers(orders: DataFrame) -> DataFrame:
    """Orders of the star schema, stored or streamed, as requests."""
    return orders.selectExpr(
        "o_orderkey AS OrderID",
        "o_custkey AS CustomerID",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS OrderDate",
        """CASE o_orderpriority WHEN '1-URGENT' THEN concat('BOOK', o_custkey)
           WHEN '2-HIGH' THEN 'SAVE20' WHEN '4-NOT SPECIFIED' THEN 'welcome10'
           WHEN '5-LOW' THEN '' END AS PromotionCode""",
        """CASE WHEN o_orderpriority = '5-LOW' THEN 9 WHEN o_orderpriority <> '3-MEDIUM'
           THEN CAST(substring(o_orderpriority, 1, 1) AS INT) END AS PaymentMethodID""",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS TotalAmount",
    )


def request_lines(spark: SparkSession, root: str) -> DataFrame:
    return source(spark, root, "lineitem").selectExpr(
        "l_orderkey AS OrderID", "l_linenumber AS Position", "l_partkey AS BookID",
        "CAST(l_quantity AS INT) AS Quantity", "CAST(l_extendedprice AS DECIMAL(18,2)) AS Price",
    )


def order_requests(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Stored orders sent in once more: headers and lines."""
    return request_headers(source(spark, root, "orders")), request_lines(spark, root)


def draft_headers(headers: DataFrame) -> DataFrame:
    """Requests with gaps: dates missing and totals too low."""
    low = F.col("PaymentMethodID") == 9
    return headers.withColumns({
        "OrderDate": F.when(low, F.lit("")).otherwise(F.col("OrderDate")),
        "TotalAmount": F.col("TotalAmount") - 20000,
    })


def draft_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"Quantity": F.col("Quantity") - 1, "Price": F.col("Price") - 1500})


def draft_orders(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    headers, lines = order_requests(spark, root)
    return draft_headers(headers), draft_lines(lines)


def promotion_uses(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Requests as a promotion check sees them, each with its order amount."""
    headers, lines = order_requests(spark, root)
    coded = headers.filter("PromotionCode <> ''").select(
        "OrderID", "CustomerID", "PromotionCode", F.col("TotalAmount").alias("SubTotal")
    )
    return coded, lines


def twice_the_keys(spark: SparkSession, root: str, table: str, key: str, name: str) -> DataFrame:
    """Ids to delete: the doubled keys of a table, half of them not stored."""
    return source(spark, root, table).select((F.col(key) * 2).alias(name))


def cancellations(spark: SparkSession, root: str) -> DataFrame:
    """Failed orders, and ids no order has."""
    failed = source(spark, root, "orders").filter("o_orderstatus = 'O'").select(
        F.col("o_orderkey").alias("OrderID"))
    unknown = source(spark, root, "customer").select((-1 - F.col("c_custkey")).alias("OrderID"))
    return failed.unionByName(unknown)


def _far_if(test: Column, key: str) -> Column:
    return F.when(test, F.col(key) + FAR).otherwise(F.col(key))


LINE_ORDER = tuple("-" + c for c in (
    "l_shipdate", "l_orderkey", "l_extendedprice", "l_quantity", "l_suppkey", "l_returnflag",
    "l_linestatus",
))


def book_changes(spark: SparkSession, root: str) -> DataFrame:
    """Each line restates a book; returned ones are new titles."""
    status = F.col("l_linestatus")
    line = source(spark, root, "lineitem")
    return line.select(
        _far_if(F.col("l_returnflag") == "A", "l_partkey").alias("BookID"),
        F.concat(F.lit("Title "), F.col("l_suppkey")).alias("Title"),
        F.col("l_returnflag").alias("Author"),
        status.alias("Genre"),
        F.col("l_extendedprice").cast(S.MONEY).alias("Price"),
        F.col("l_quantity").cast("int").alias("Stock"),
        F.when(status == "F", F.col("l_quantity").cast("long") * 2).alias("InputQuantity"),
        F.when(status == "F", F.lit(1).cast("long")).alias("OutputQuantity"),
        F.col("l_suppkey").alias("SupplierID"),
        *(c for c in line.columns if c not in ("l_linenumber", "l_discount", "l_tax")),
    )


def customer_changes(spark: SparkSession, root: str) -> DataFrame:
    order = source(spark, root, "orders")
    status = F.col("o_orderstatus")
    return order.select(
        _far_if(status == "P", "o_custkey").alias("CustomerID"),
        F.concat(F.lit("Name "), F.col("o_orderkey")).alias("Name"),
        F.when(status != "O", F.lower("o_orderpriority")).alias("Email"),
        F.col("o_orderkey").cast("string").alias("Phone"),
        "o_orderdate", "o_orderkey",
    )


def supplier_changes(spark: SparkSession, root: str) -> DataFrame:
    line = source(spark, root, "lineitem")
    return line.select(
        _far_if(F.col("l_returnflag") == "A", "l_suppkey").alias("SupplierID"),
        F.concat(F.lit("Name "), F.col("l_orderkey")).alias("Name"),
        F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).alias("Address"),
        F.col("l_partkey").cast("string").alias("Phone"),
        "l_shipdate", "l_orderkey", "l_extendedprice", "l_quantity", "l_partkey", "l_linestatus",
        "l_returnflag",
    )


def promotion_changes(spark: SparkSession, root: str) -> DataFrame:
    """Every part campaign with a raised value and a later end, the largest ones new."""
    stored = part_promotions(spark, root)
    return stored.withColumns({
        "PromotionID": _far_if(F.col("MinimumOrderAmount") > 45000, "PromotionID"),
        "DiscountValue": F.col("DiscountValue") + 1,
        "MaximumDiscount": F.lit(None).cast(S.MONEY),
        "EndDate": F.date_add("EndDate", 30),
        "UpdatedAt": F.lit("2024-06-15 12:00:00").cast("timestamp"),
    })


def order_changes(spark: SparkSession, root: str) -> DataFrame:
    line = source(spark, root, "lineitem")
    return line.select(
        _far_if(F.col("l_returnflag") == "N", "l_orderkey").alias("OrderID"),
        F.col("l_suppkey").alias("CustomerID"),
        F.col("l_shipdate").cast("date").alias("OrderDate"),
        F.col("l_extendedprice").cast(S.MONEY).alias("TotalAmount"),
        "l_shipdate", "l_extendedprice", "l_suppkey",
    )


def target_changes(spark: SparkSession, root: str) -> DataFrame:
    number = F.col("p_partkey") + len(S.SEED_PROMOTIONS) + 1
    product = F.col("p_type") != "LARGE"
    return source(spark, root, "part").filter("p_size <= 25").select(
        (number + FAR).alias("TargetID"),
        number.alias("PromotionID"),
        F.when(product, "product").otherwise("all").alias("TargetType"),
        F.when(product, F.col("p_partkey")).alias("TargetID_Value"),
    )


def stock_deltas(spark: SparkSession, root: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("long")
    return source(spark, root, "lineitem").select(
        F.col("l_partkey").alias("BookID"),
        F.when(F.col("l_returnflag") == "R", quantity).otherwise(-quantity).alias("Delta"),
    )


def payment_events(events: DataFrame) -> DataFrame:
    """Events of a user read as the payment steps of the order with that number."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "paid").when(kind == "error", "failed").when(
        kind == "signup", "refunded").otherwise("pending")
    return events.select(
        F.col("event_id").alias("EventID"),
        F.col("user_id").alias("OrderID"),
        F.col("ts").cast("timestamp").alias("At"),
        status.alias("Status"),
        F.when(kind == "purchase", 3).when(kind == "signup", 5).alias("PaymentMethodID"),
        F.col("props").alias("TransactionID"),
    )


def request_texts(events: DataFrame) -> DataFrame:
    """Events as JSON order requests of the book that their props name; what goes wrong depends on the kind of event."""
    book, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    quantity = F.when(kind == "signup", '"two"').otherwise("2")
    items = F.when(kind == "view", "null").when(kind == "click", "[]").otherwise(
        F.concat(F.lit('[{"BookID":1,"Quantity":1},{"BookID":'), book, F.lit(',"Quantity":'), quantity, F.lit("}]")))
    text = F.concat(
        F.lit('{"OrderID":'), F.col("event_id"), F.lit(',"CustomerID":'), F.col("user_id"), F.lit(',"items":'), items, F.lit("}"))
    cut = F.when(kind == "error", F.left(text, F.length(text) - 3)).otherwise(text)
    return events.select("event_id", F.when(book != "13", cut).alias("Text"))


def purchases(events: DataFrame) -> DataFrame:
    """Purchase events as sales."""
    return events.filter("event_type = 'purchase'").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("CustomerID"),
        F.col("value").cast(S.MONEY).alias("Amount"),
    )


def referring_orders(spark: SparkSession, root: str) -> DataFrame:
    """Orders to be stored, the low ones with a payment method that no shop has."""
    low = source(spark, root, "orders").filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("OrderID"))
    order = orders(spark, root).select("OrderID", "CustomerID", "PaymentMethodID", "PromotionID")
    marked = order.join(low.withColumn("_low", F.lit(True)), "OrderID", "left")
    return marked.withColumn(
        "PaymentMethodID", F.when(F.col("_low"), F.lit(9)).otherwise(F.col("PaymentMethodID"))).drop("_low")


def referring_lines(spark: SparkSession, root: str) -> DataFrame:
    """Order lines to be stored: some of orders, some of books that there aren't."""
    return source(spark, root, "lineitem").select(
        _far_if(F.col("l_returnflag") == "A", "l_orderkey").alias("OrderID"),
        F.col("l_linenumber").alias("Position"),
        _far_if(F.col("l_quantity") >= 45, "l_partkey").alias("BookID"),
    )


def referring_targets(spark: SparkSession, root: str) -> DataFrame:
    """Targets of promotions of which half aren't stored."""
    number = F.col("p_partkey")
    return source(spark, root, "part").select(
        number.alias("TargetID"), (number * 2 + len(S.SEED_PROMOTIONS) + 1).alias("PromotionID"))


def deliveries(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Requests as they are delivered: paid orders once more, others under new numbers, pending ones twice.

    Headers and lines have a ``Delivery``; the second one of a request asks for more.
    """
    order = source(spark, root, "orders")
    fresh, again = F.col("o_orderstatus") != "F", F.col("o_orderstatus") == "P"
    times = F.explode(F.when(again, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("Delivery")
    sent = order.withColumn("o_orderkey", _far_if(fresh, "o_orderkey"))
    first = request_headers(sent).withColumn("Delivery", F.lit(1))
    second = request_headers(sent.filter(again)).withColumn("Delivery", F.lit(2))
    numbers = order.select(F.col("o_orderkey").alias("OrderID"), _far_if(fresh, "o_orderkey").alias("_number"), times)
    line = request_lines(spark, root).join(numbers, "OrderID")
    lines = line.withColumns({"OrderID": F.col("_number"), "Quantity": F.col("Quantity") + F.col("Delivery") - 1})
    return first.unionByName(second), lines.drop("_number")
