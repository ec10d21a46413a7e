"""DuckDB SQL giving the expected result of every query that SQL can express.

Each query restates the adapter of the star schema as common table expressions
and answers from the definition of the report, not from the way Spark runs it:
joins are not pre-aggregated, lists of rules are plain CASE chains.

A column list gives the type each column is compared in: ``s`` text, ``n``
whole number, ``d`` double, ``b`` boolean, ``x`` nullable whole number as text,
``t`` date, ``T`` time.
"""

from __future__ import annotations

NOW = "TIMESTAMP '2001-08-01 12:00:00'"
TODAY = "DATE '2001-08-01'"
PROMO_TODAY = "DATE '2024-06-15'"

_CASTS = {
    "s": "CAST({c} AS VARCHAR)",
    "n": "CAST({c} AS BIGINT)",
    "d": "CAST({c} AS DOUBLE)",
    "b": "CAST({c} AS BOOLEAN)",
    "x": "CAST(CAST({c} AS BIGINT) AS VARCHAR)",
    "t": "strftime({c}, '%Y-%m-%d')",
    "T": "strftime({c}, '%Y-%m-%d %H:%M:%S')",
}

# Fixed rows every shop starts with.
_SEEDS = """
  payment_methods(PaymentMethodID, MethodName) AS (VALUES
    (1, 'Cash'), (2, 'Bank Transfer'), (3, 'Credit Card'), (4, 'E-wallet'), (5, 'COD')),
  promotion_types(TypeID, TypeName) AS (VALUES
    (1, 'Product Discount'), (2, 'Customer Discount'), (3, 'Category Discount'),
    (4, 'Order Discount'), (5, 'New Customer'), (6, 'Loyalty'), (7, 'Seasonal'), (8, 'Flash Sale')),
  seed_promotions(PromotionID, PromotionCode, PromotionName, Description, DiscountType,
                  DiscountValue, MinimumOrderAmount, UsageLimit) AS (VALUES
    (1, 'WELCOME10', 'Giảm giá 10% cho khách hàng mới', 'Áp dụng cho đơn hàng đầu tiên',
     'percentage', 10, 100000, 100),
    (2, 'SAVE20', 'Giảm giá 20,000đ cho đơn hàng từ 200,000đ', 'Áp dụng cho tất cả khách hàng',
     'fixed_amount', 20000, 200000, 50),
    (3, 'BOOKSALE', 'Giảm giá 15% cho sách văn học', 'Áp dụng cho sách văn học',
     'percentage', 15, 50000, 200),
    (4, 'LOYALTY5', 'Giảm giá 5% cho khách hàng thân thiết',
     'Áp dụng cho khách hàng có từ 3 đơn hàng trở lên', 'percentage', 5, 0, NULL)),
  seed_targets(TargetID, PromotionID, TargetType) AS (VALUES
    (1, 1, 'customer'), (2, 2, 'all'), (3, 3, 'category'), (4, 4, 'customer')),
"""

_ADAPTER = """
  books AS (
    SELECT p_partkey AS BookID, p_name AS Title, p_brand AS Author, p_type AS Genre,
           CAST(p_retailprice AS DECIMAL(18,2)) AS Price, p_size AS Stock,
           CAST(p_size AS BIGINT) AS InputQuantity, CAST(0 AS BIGINT) AS OutputQuantity,
           CAST(substr(p_brand, 7) AS BIGINT) AS SupplierID
    FROM part),
  customers AS (
    SELECT c_custkey AS CustomerID, c_name AS Name,
           lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example' AS Email,
           CAST(10000000000 + c_custkey AS VARCHAR) AS Phone
    FROM customer),
  suppliers AS (
    SELECT s_suppkey AS SupplierID, s_name AS Name, 'Nation ' || s_nationkey AS Address,
           CAST(20000000000 + s_suppkey AS VARCHAR) AS Phone
    FROM supplier),
  order_base AS (
    SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
           CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN o_custkey + 5 END AS promo,
           CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'pending' ELSE 'failed' END AS status
    FROM main.orders),
  order_cut AS (
    SELECT *, CASE WHEN promo IS NULL THEN 0
                   ELSE CAST(total * CAST(0.05 AS DECIMAL(3,2)) AS DECIMAL(18,2)) END AS cut
    FROM order_base),
  shop_orders AS (
    SELECT o_orderkey AS OrderID, o_custkey AS CustomerID, CAST(o_orderdate AS DATE) AS OrderDate,
           total + cut AS SubTotal, cut AS DiscountAmount, total AS TotalAmount,
           CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
                THEN CAST(left(o_orderpriority, 1) AS INT) END AS PaymentMethodID,
           promo AS PromotionID, status AS PaymentStatus,
           CASE WHEN status = 'paid' THEN CAST(o_orderdate AS TIMESTAMP) END AS PaymentDate,
           CASE WHEN status = 'paid' THEN 'TXN_' || o_orderkey END AS TransactionID
    FROM order_cut),
  order_details AS (
    SELECT l_orderkey AS OrderID, l_partkey AS BookID, CAST(l_quantity AS INT) AS Quantity,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS Price
    FROM lineitem),
  part_terms AS (
    SELECT *, p_partkey + 5 AS number, p_type IN ('ECONOMY', 'PROMO', 'SMALL') AS share,
           DATE '2024-01-01' + p_size AS started
    FROM part),
  promotions AS (
    SELECT PromotionID, PromotionCode, PromotionName, Description, DiscountType,
           CAST(DiscountValue AS DECIMAL(18,2)) AS DiscountValue,
           CAST(MinimumOrderAmount AS DECIMAL(18,2)) AS MinimumOrderAmount,
           CAST(NULL AS DECIMAL(18,2)) AS MaximumDiscount,
           DATE '2024-01-01' AS StartDate, DATE '2024-12-31' AS EndDate, TRUE AS IsActive,
           UsageLimit, 0 AS UsedCount, TIMESTAMP '2024-01-01 00:00:00' AS CreatedAt,
           TIMESTAMP '2024-01-01 00:00:00' AS UpdatedAt
    FROM seed_promotions
    UNION ALL
    SELECT number, 'BOOK' || p_partkey, p_name, p_type,
           CASE WHEN share THEN 'percentage' ELSE 'fixed_amount' END,
           CAST(CASE WHEN share THEN p_size ELSE p_retailprice END AS DECIMAL(18,2)),
           CAST(p_size * 1000 AS DECIMAL(18,2)),
           CASE WHEN p_size > 25 THEN CAST(p_retailprice AS DECIMAL(18,2)) END,
           started, started + 140, p_brand <> 'Brand#13',
           CASE WHEN p_size <= 40 THEN p_size * 2 END, CASE WHEN p_size = 40 THEN 80 ELSE 1 END,
           CAST(started AS TIMESTAMP), CAST(started AS TIMESTAMP)
    FROM part_terms),
  target_types(p_type, pos, TargetType) AS (VALUES
    ('ECONOMY', 0, 'product'), ('ECONOMY', 1, 'all'), ('STANDARD', 0, 'product'),
    ('PROMO', 0, 'customer'), ('SMALL', 0, 'category'), ('LARGE', 0, 'all'),
    ('LARGE', 1, 'product'), ('MEDIUM', 0, 'all')),
  promotion_targets AS (
    SELECT TargetID, PromotionID, TargetType, CAST(NULL AS BIGINT) AS TargetID_Value FROM seed_targets
    UNION ALL
    SELECT 2 * (p_partkey + 5) + pos, p_partkey + 5, TargetType,
           CASE WHEN TargetType IN ('product', 'customer') THEN p_partkey END
    FROM part JOIN target_types USING (p_type)),
  promotion_usage AS (
    SELECT OrderID AS UsageID, PromotionID, OrderID, CustomerID, DiscountAmount,
           CAST(OrderDate AS TIMESTAMP) AS UsedAt
    FROM shop_orders WHERE PromotionID IS NOT NULL),
"""

_REQUESTS = """
  request_headers AS (
    SELECT o_orderkey AS OrderID, o_custkey AS CustomerID,
           strftime(o_orderdate, '%Y-%m-%d') AS OrderDate,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'BOOK' || o_custkey WHEN '2-HIGH' THEN 'SAVE20'
                WHEN '4-NOT SPECIFIED' THEN 'welcome10' WHEN '5-LOW' THEN '' END AS PromotionCode,
           CASE WHEN o_orderpriority = '5-LOW' THEN 9
                WHEN o_orderpriority <> '3-MEDIUM' THEN CAST(left(o_orderpriority, 1) AS INT)
           END AS PaymentMethodID,
           CAST(o_totalprice AS DECIMAL(18,2)) AS TotalAmount
    FROM main.orders),
  request_lines AS (
    SELECT l_orderkey AS OrderID, l_linenumber AS Position, l_partkey AS BookID,
           CAST(l_quantity AS INT) AS Quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS Price
    FROM lineitem),
  usable AS (
    SELECT * FROM promotions
    WHERE IsActive AND StartDate <= {today} AND EndDate >= {today}
      AND (UsageLimit IS NULL OR UsedCount < UsageLimit)),
""".replace("{today}", PROMO_TODAY)

_ORACLES: dict[str, str] = {}
_COLUMNS: dict[str, str] = {}


def _add(name: str, columns: str, body: str, extra: str = "", requests: str = _REQUESTS) -> None:
    """Register a query; ``extra`` holds further common table expressions, ``requests`` those of what comes in."""
    _COLUMNS[name] = columns
    picked = ", ".join(
        _CASTS[kind].format(c=f'"{column}"') + f' AS "{column}"'
        for column, kind in (item.split(":") for item in columns.split())
    )
    _ORACLES[name] = f"WITH{_SEEDS}{_ADAPTER}{requests}{extra} result AS ({body}) SELECT {picked} FROM result"


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# --- dashboard -------------------------------------------------------------

_LAST_30 = f"OrderDate >= {NOW} - INTERVAL 30 DAY"

_add("dash_overview",
     "TotalBooks:n TotalStock:n LowStockBooks:n InventoryValue:d TotalOrders:n TotalRevenue:d "
     "ActiveCustomers:n OrdersThisMonth:n RevenueThisMonth:d TotalCustomers:n TotalSuppliers:n",
     f"""SELECT
       (SELECT count(*) FROM books) AS TotalBooks,
       (SELECT count(*) FROM customers) AS TotalCustomers,
       (SELECT count(*) FROM shop_orders) AS TotalOrders,
       (SELECT count(*) FROM suppliers) AS TotalSuppliers,
       (SELECT coalesce(sum(TotalAmount), 0) FROM shop_orders) AS TotalRevenue,
       (SELECT coalesce(sum(Stock), 0) FROM books) AS TotalStock,
       (SELECT count(*) FROM books WHERE Stock <= 5) AS LowStockBooks,
       (SELECT count(DISTINCT CustomerID) FROM shop_orders) AS ActiveCustomers,
       (SELECT coalesce(sum(Stock * Price), 0) FROM books) AS InventoryValue,
       (SELECT count(*) FROM shop_orders WHERE {_LAST_30}) AS OrdersThisMonth,
       (SELECT coalesce(sum(TotalAmount), 0) FROM shop_orders WHERE {_LAST_30}) AS RevenueThisMonth""")

_PERIOD = """SELECT strftime(OrderDate, '{pattern}') AS {name}, count(*) AS OrderCount,
       coalesce(sum(TotalAmount), 0) AS Revenue, count(DISTINCT CustomerID) AS UniqueCustomers
     FROM shop_orders WHERE OrderDate >= {now} - INTERVAL {span}
     GROUP BY 1 ORDER BY 1 DESC {limit}"""


def _period(name: str, pattern: str, span: str, limit: str = "") -> str:
    return _PERIOD.format(name=name, pattern=pattern, span=span, limit=limit, now=NOW)


_add("dash_monthly", "Month:s OrderCount:n Revenue:d UniqueCustomers:n",
     _period("Month", "%Y-%m", "12 MONTH", "LIMIT 12"))
_add("dash_sales_chart_month", "Period:s OrderCount:n Revenue:d UniqueCustomers:n",
     _period("Period", "%Y-%m", "12 MONTH"))
_add("dash_sales_chart_day", "Period:s OrderCount:n Revenue:d UniqueCustomers:n",
     _period("Period", "%Y-%m-%d", "30 DAY"))

_TOP_BOOKS = """SELECT b.BookID, b.Title, b.Author, b.Genre, b.Price,
       coalesce(sum(od.Quantity), 0) AS TotalSold,
       coalesce(sum(od.Quantity * od.Price), 0) AS TotalRevenue
     FROM books b LEFT JOIN order_details od ON b.BookID = od.BookID
     GROUP BY ALL ORDER BY TotalSold DESC, TotalRevenue DESC, b.BookID LIMIT 10"""
_BOOK_COLUMNS = "BookID:n Title:s Author:s Genre:s Price:d TotalSold:n TotalRevenue:d"
_add("dash_top_books", _BOOK_COLUMNS, _TOP_BOOKS)
_add("top_rank_books", _BOOK_COLUMNS + " Rank:n",
     f"""SELECT *, row_number() OVER (ORDER BY TotalSold DESC, TotalRevenue DESC, BookID) AS Rank
         FROM ({_TOP_BOOKS})""")

_TOP_CUSTOMERS = """SELECT c.CustomerID, c.Name, c.Email, count(o.OrderID) AS OrderCount,
       coalesce(sum(o.TotalAmount), 0) AS TotalSpent, max(o.OrderDate) AS LastOrderDate
     FROM customers c LEFT JOIN shop_orders o ON c.CustomerID = o.CustomerID
     GROUP BY ALL ORDER BY TotalSpent DESC, OrderCount DESC, c.CustomerID LIMIT 10"""
_CUSTOMER_COLUMNS = "CustomerID:x Name:s Email:s OrderCount:n TotalSpent:d LastOrderDate:t"
_add("dash_top_customers", _CUSTOMER_COLUMNS, _TOP_CUSTOMERS)
_add("top_rank_customers", _CUSTOMER_COLUMNS + " Rank:n",
     f"""SELECT *, row_number() OVER (ORDER BY TotalSpent DESC, OrderCount DESC, CustomerID) AS Rank
         FROM ({_TOP_CUSTOMERS})""")

_add("dash_low_stock", "BookID:n Title:s Author:s Genre:s Price:d Stock:n SupplierName:s",
     """SELECT b.*, s.Name AS SupplierName FROM books b LEFT JOIN suppliers s USING (SupplierID)
        WHERE b.Stock <= 5 ORDER BY b.Stock, b.BookID LIMIT 10""")

_SOLD_BY_BOOK = """
  sold_by_book AS (
    SELECT b.BookID, coalesce(sum(od.Quantity), 0) AS sold,
           coalesce(sum(od.Quantity * od.Price), 0) AS revenue
    FROM books b LEFT JOIN order_details od ON b.BookID = od.BookID GROUP BY 1),
"""
_GENRE_COLUMNS = "Genre:s BookCount:n TotalStock:n TotalSold:n TotalRevenue:d"
_add("dash_genre", _GENRE_COLUMNS,
     """SELECT b.Genre, count(b.BookID) AS BookCount, coalesce(sum(b.Stock), 0) AS TotalStock,
          coalesce(sum(od.Quantity), 0) AS TotalSold,
          coalesce(sum(od.Quantity * od.Price), 0) AS TotalRevenue
        FROM books b LEFT JOIN order_details od ON b.BookID = od.BookID GROUP BY 1""")
_add("dash_genre_exact", _GENRE_COLUMNS,
     """SELECT Genre, count(*) AS BookCount, sum(Stock) AS TotalStock, sum(sold) AS TotalSold,
          sum(revenue) AS TotalRevenue FROM books JOIN sold_by_book USING (BookID) GROUP BY 1""",
     _SOLD_BY_BOOK)

_SUPPLIER_REPORT = ("SupplierID:x SupplierName:s Address:s Phone:s BookCount:n TotalStock:n "
                    "InventoryValue:d TotalSold:n TotalRevenue:d")
_add("dash_supplier", _SUPPLIER_REPORT,
     """SELECT s.SupplierID, s.Name AS SupplierName, s.Address, s.Phone,
          count(b.BookID) AS BookCount, coalesce(sum(b.Stock), 0) AS TotalStock,
          coalesce(sum(b.Stock * b.Price), 0) AS InventoryValue,
          coalesce(sum(od.Quantity), 0) AS TotalSold,
          coalesce(sum(od.Quantity * od.Price), 0) AS TotalRevenue
        FROM suppliers s LEFT JOIN books b ON s.SupplierID = b.SupplierID
          LEFT JOIN order_details od ON b.BookID = od.BookID GROUP BY ALL""")
_add("dash_supplier_exact", _SUPPLIER_REPORT,
     """SELECT s.SupplierID, s.Name AS SupplierName, s.Address, s.Phone,
          count(b.BookID) AS BookCount, coalesce(sum(b.Stock), 0) AS TotalStock,
          coalesce(sum(b.Stock * b.Price), 0) AS InventoryValue,
          coalesce(sum(sold), 0) AS TotalSold, coalesce(sum(revenue), 0) AS TotalRevenue
        FROM suppliers s LEFT JOIN books b ON s.SupplierID = b.SupplierID
          LEFT JOIN sold_by_book USING (BookID) GROUP BY ALL""", _SOLD_BY_BOOK)


def _avg(column: str) -> str:
    """Average of a money column with six decimals; null over no rows."""
    return f"round(CAST(sum({column}) AS DOUBLE) / count({column}), 6)"


_add("dash_inventory",
     "TotalBooks:n TotalStock:n TotalValue:d AveragePrice:d LowStockCount:n OutOfStockCount:n "
     "HighStockCount:n LowStockValue:d",
     f"""SELECT count(*) AS TotalBooks, coalesce(sum(Stock), 0) AS TotalStock,
          coalesce(sum(Stock * Price), 0) AS TotalValue, coalesce({_avg("Price")}, 0) AS AveragePrice,
          count(CASE WHEN Stock <= 5 THEN 1 END) AS LowStockCount,
          count(CASE WHEN Stock = 0 THEN 1 END) AS OutOfStockCount,
          count(CASE WHEN Stock > 20 THEN 1 END) AS HighStockCount,
          coalesce(sum(CASE WHEN Stock <= 5 THEN Stock * Price ELSE 0 END), 0) AS LowStockValue
        FROM books""")

_GROWTH = "Month:s NewCustomers:n TotalOrders:n TotalRevenue:d"
_add("dash_customer_growth", _GROWTH,
     f"""SELECT Month, UniqueCustomers AS NewCustomers, OrderCount AS TotalOrders,
           Revenue AS TotalRevenue FROM ({_period("Month", "%Y-%m", "12 MONTH")})""")
_add("dash_customer_growth_exact", _GROWTH,
     f"""SELECT m.Month, OrderCount AS TotalOrders, Revenue AS TotalRevenue,
           (SELECT count(*) FROM (SELECT CustomerID, min(OrderDate) AS d FROM shop_orders GROUP BY 1) f
            WHERE strftime(f.d, '%Y-%m') = m.Month AND f.d >= {NOW} - INTERVAL 12 MONTH) AS NewCustomers
         FROM ({_period("Month", "%Y-%m", "12 MONTH")}) m""")
_add("dash_sales_trends",
     "Date:s DailyOrders:n DailyRevenue:d DailyCustomers:n AverageOrderValue:d",
     f"""SELECT strftime(OrderDate, '%Y-%m-%d') AS Date, count(*) AS DailyOrders,
           coalesce(sum(TotalAmount), 0) AS DailyRevenue,
           count(DISTINCT CustomerID) AS DailyCustomers,
           coalesce({_avg("TotalAmount")}, 0) AS AverageOrderValue
         FROM shop_orders WHERE {_LAST_30} GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")


def _recency(code: str, label: str, test: str) -> str:
    return f"""SELECT '{code}' AS Code, '{label}' AS Status, count(*) AS Count,
      coalesce(sum(TotalAmount), 0) AS TotalValue FROM shop_orders WHERE {test}"""


_add("dash_order_recency", "Code:s Status:s Count:n TotalValue:d", " UNION ALL ".join([
    _recency("all", "Tổng đơn hàng", "TRUE"),
    _recency("last_30_days", "Đơn hàng tháng này", _LAST_30),
    _recency("last_7_days", "Đơn hàng tuần này", f"OrderDate >= {NOW} - INTERVAL 7 DAY"),
    _recency("today", "Đơn hàng hôm nay", f"OrderDate = {TODAY}"),
]))
_add("dash_new_books",
     "TotalNewBooks:n TotalStock:n TotalValue:d AveragePrice:d AvailableBooks:n OutOfStockBooks:n",
     f"""SELECT count(*) AS TotalNewBooks, coalesce(sum(Stock), 0) AS TotalStock,
           coalesce(sum(Stock * Price), 0) AS TotalValue, coalesce({_avg("Price")}, 0) AS AveragePrice,
           count(CASE WHEN Stock > 0 THEN 1 END) AS AvailableBooks,
           count(CASE WHEN Stock = 0 THEN 1 END) AS OutOfStockBooks
         FROM books WHERE BookID > (SELECT max(BookID) - 10 FROM books)""")
_add("dash_recent_orders",
     "OrderID:n OrderDate:t TotalAmount:d CustomerName:s CustomerEmail:s ItemCount:n",
     """SELECT o.OrderID, o.OrderDate, o.TotalAmount, c.Name AS CustomerName,
          c.Email AS CustomerEmail, count(od.BookID) AS ItemCount
        FROM shop_orders o LEFT JOIN customers c ON o.CustomerID = c.CustomerID
          LEFT JOIN order_details od ON o.OrderID = od.OrderID
        GROUP BY ALL ORDER BY o.OrderDate DESC, o.OrderID DESC LIMIT 10""")
_add("insight_summary",
     "TotalRevenue:d TotalOrders:n TotalBooks:n TotalCustomers:n LowStockAlert:n "
     "AverageOrderValue:d StockAdvice:s CustomerAdvice:s SalesAdvice:s",
     """SELECT *, CASE WHEN LowStockAlert > 0 THEN 'restock' ELSE 'stable' END AS StockAdvice,
          CASE WHEN TotalCustomers > 0 THEN 'grow' ELSE 'market' END AS CustomerAdvice,
          CASE WHEN AverageOrderValue > 0 THEN 'cross_sell' ELSE 'improve' END AS SalesAdvice
        FROM (SELECT coalesce(sum(TotalAmount), 0) AS TotalRevenue, count(*) AS TotalOrders,
          (SELECT count(*) FROM books) AS TotalBooks,
          (SELECT count(*) FROM customers) AS TotalCustomers,
          (SELECT count(*) FROM books WHERE Stock <= 5) AS LowStockAlert,
          CASE WHEN sum(TotalAmount) > 0 THEN CAST(sum(TotalAmount) AS DOUBLE) / count(*) ELSE 0
          END AS AverageOrderValue FROM shop_orders)""")
_add("low_stock_pct", "LowStockPercent:n",
     """SELECT coalesce(round(100.0 * count(*) FILTER (Stock <= 5) / nullif(count(*), 0)), 0)
          AS LowStockPercent FROM books""")

# --- revenue ---------------------------------------------------------------

_add("rev_weekly",
     "WeekNumber:n WeekStart:s WeekEnd:s OrderCount:n Revenue:d UniqueCustomers:n",
     f"""SELECT isoyear(OrderDate) * 100 + weekofyear(OrderDate) AS WeekNumber,
           strftime(min(OrderDate), '%Y-%m-%d') AS WeekStart,
           strftime(max(OrderDate), '%Y-%m-%d') AS WeekEnd, count(*) AS OrderCount,
           coalesce(sum(TotalAmount), 0) AS Revenue, count(DISTINCT CustomerID) AS UniqueCustomers
         FROM shop_orders WHERE OrderDate >= {NOW} - INTERVAL 28 DAY
         GROUP BY 1 ORDER BY 1 DESC LIMIT 4""")
_add("rev_monthly",
     "Month:s Year:s MonthNumber:s OrderCount:n Revenue:d UniqueCustomers:n",
     f"""SELECT *, left(Month, 4) AS Year, right(Month, 2) AS MonthNumber
         FROM ({_period("Month", "%Y-%m", "12 MONTH", "LIMIT 12")})""")
_add("rev_yearly", "Year:n OrderCount:n Revenue:d UniqueCustomers:n",
     """SELECT year(OrderDate) AS Year, count(*) AS OrderCount,
          coalesce(sum(TotalAmount), 0) AS Revenue, count(DISTINCT CustomerID) AS UniqueCustomers
        FROM shop_orders GROUP BY 1 ORDER BY 1 DESC LIMIT 5""")


def _within(days: int, value: str) -> str:
    return (f"coalesce(sum(CASE WHEN OrderDate >= {NOW} - INTERVAL {days} DAY "
            f"THEN {value} ELSE 0 END), 0)")


_add("rev_summary",
     "ThisWeekRevenue:d ThisMonthRevenue:d ThisYearRevenue:d ThisWeekOrders:n ThisMonthOrders:n "
     "ThisYearOrders:n AverageOrderValue:d HighestOrderValue:d",
     f"""SELECT {_within(7, "TotalAmount")} AS ThisWeekRevenue,
           {_within(30, "TotalAmount")} AS ThisMonthRevenue,
           {_within(365, "TotalAmount")} AS ThisYearRevenue,
           {_within(7, "1")} AS ThisWeekOrders, {_within(30, "1")} AS ThisMonthOrders,
           {_within(365, "1")} AS ThisYearOrders,
           coalesce({_avg("TotalAmount")}, 0) AS AverageOrderValue,
           coalesce(max(TotalAmount), 0) AS HighestOrderValue FROM shop_orders""")

# --- books, customers, suppliers -------------------------------------------

_BOOK = ("BookID:n Title:s Author:s Genre:s Price:d Stock:n InputQuantity:n OutputQuantity:n "
         "SupplierID:x")
_NAMED_BOOK = _BOOK + " SupplierName:s"
_NAMED_BOOKS = "SELECT b.*, s.Name AS SupplierName FROM books b LEFT JOIN suppliers s USING (SupplierID)"
_add("book_list", _NAMED_BOOK, _NAMED_BOOKS)
_add("book_lookup", _NAMED_BOOK,
     f"{_NAMED_BOOKS} WHERE b.BookID IN (SELECT BookID FROM order_details)")
_add("book_search", _NAMED_BOOK,
     f"""{_NAMED_BOOKS} WHERE b.Title ILIKE '%RED%ring%' OR b.Author ILIKE '%RED%ring%'
         OR b.Genre ILIKE '%RED%ring%'""")
_add("book_low_stock", _NAMED_BOOK, f"{_NAMED_BOOKS} WHERE b.Stock <= 5")
_add("book_typeahead", _BOOK,
     """SELECT * FROM books WHERE contains(lower(Title), 'widget') OR contains(lower(Author), 'widget')
        OR contains(lower(Genre), 'widget') ORDER BY BookID LIMIT 10""")
_add("stock_levels",
     "BookID:n Title:s Stock:n StockStatus:s StockTier:s CurrentStock:n",
     """SELECT *, CASE WHEN Stock = 0 THEN 'out' WHEN Stock <= 5 THEN 'low' ELSE 'ok' END AS StockStatus,
          CASE WHEN Stock > 10 THEN 'high' WHEN Stock > 5 THEN 'medium' ELSE 'low' END AS StockTier,
          greatest(0, InputQuantity - OutputQuantity) AS CurrentStock FROM books""")

_CUSTOMER = "CustomerID:x Name:s Email:s Phone:s"
_CUSTOMER_TOTALS = _CUSTOMER + " TotalOrders:n TotalSpent:d"
_CUSTOMERS = """SELECT c.*, count(o.OrderID) AS TotalOrders,
       coalesce(sum(o.TotalAmount), 0) AS TotalSpent
     FROM customers c LEFT JOIN shop_orders o ON c.CustomerID = o.CustomerID {where} GROUP BY ALL"""
_add("customer_list", _CUSTOMER_TOTALS, _CUSTOMERS.format(where=""))
_add("customer_lookup", _CUSTOMER,
     "SELECT * FROM customers WHERE CustomerID IN (SELECT CustomerID FROM shop_orders)")
_add("customer_search", _CUSTOMER_TOTALS, _CUSTOMERS.format(
    where="""WHERE c.Name ILIKE '%building%' OR c.Email ILIKE '%building%'
             OR c.Phone ILIKE '%building%'"""))
_add("customer_top", _CUSTOMER_TOTALS,
     _CUSTOMERS.format(where="") + " ORDER BY TotalSpent DESC, c.CustomerID LIMIT 10")

_ORDER = ("OrderID:n CustomerID:x OrderDate:t SubTotal:d DiscountAmount:d TotalAmount:d "
          "PaymentMethodID:x PromotionID:x PaymentStatus:s PaymentDate:T TransactionID:s")
_add("customer_orders", _ORDER + " TotalItems:n",
     """SELECT o.*, count(od.BookID) AS TotalItems
        FROM shop_orders o LEFT JOIN order_details od ON o.OrderID = od.OrderID
        WHERE o.CustomerID IN (SELECT CustomerID FROM customers) GROUP BY ALL""")

_SUPPLIER = "SupplierID:x Name:s Address:s Phone:s"
_SUPPLIER_TOTALS = _SUPPLIER + " TotalBooks:n TotalStock:n"
_SUPPLIERS = """SELECT s.*, count(b.BookID) AS TotalBooks, coalesce(sum(b.Stock), 0) AS TotalStock
     FROM suppliers s LEFT JOIN books b ON s.SupplierID = b.SupplierID {where} GROUP BY ALL"""
_add("supplier_list", _SUPPLIER_TOTALS, _SUPPLIERS.format(where=""))
_add("supplier_lookup", _SUPPLIER,
     "SELECT * FROM suppliers WHERE SupplierID IN (SELECT SupplierID FROM books)")
_add("supplier_search", _SUPPLIER_TOTALS, _SUPPLIERS.format(
    where="""WHERE s.Name ILIKE '%nation 1_%' OR s.Address ILIKE '%nation 1_%'
             OR s.Phone ILIKE '%nation 1_%'"""))
_add("supplier_books", _NAMED_BOOK,
     f"{_NAMED_BOOKS} WHERE b.SupplierID IN (SELECT SupplierID FROM suppliers)")
_add("supplier_top", _SUPPLIER_TOTALS, _SUPPLIERS.format(where="")
     + " ORDER BY TotalBooks DESC, TotalStock DESC, s.SupplierID LIMIT 5")
_SUPPLIER_STATS = "TotalSuppliers:n ActiveSuppliers:n TotalStock:n"
_add("supplier_stats", _SUPPLIER_STATS,
     """SELECT count(*) AS TotalSuppliers, count(CASE WHEN b.BookID IS NOT NULL THEN 1 END) AS ActiveSuppliers,
          coalesce(sum(b.Stock), 0) AS TotalStock
        FROM suppliers s LEFT JOIN books b ON s.SupplierID = b.SupplierID""")
_add("supplier_stats_exact", _SUPPLIER_STATS,
     """SELECT count(DISTINCT s.SupplierID) AS TotalSuppliers,
          count(DISTINCT b.SupplierID) AS ActiveSuppliers, coalesce(sum(b.Stock), 0) AS TotalStock
        FROM suppliers s LEFT JOIN books b ON s.SupplierID = b.SupplierID""")

# --- orders and payments ---------------------------------------------------

_add("order_list",
     _ORDER + " CustomerName:s CustomerEmail:s TotalItems:n PaymentMethodName:s PromotionCode:s "
     "PromotionName:s",
     """SELECT o.*, c.Name AS CustomerName, c.Email AS CustomerEmail, count(od.BookID) AS TotalItems,
          pm.MethodName AS PaymentMethodName, p.PromotionCode, p.PromotionName
        FROM shop_orders o LEFT JOIN customers c ON o.CustomerID = c.CustomerID
          LEFT JOIN order_details od ON o.OrderID = od.OrderID
          LEFT JOIN payment_methods pm ON o.PaymentMethodID = pm.PaymentMethodID
          LEFT JOIN promotions p ON o.PromotionID = p.PromotionID GROUP BY ALL""")
_add("order_lookup", _ORDER + " CustomerName:s CustomerEmail:s",
     """SELECT o.*, c.Name AS CustomerName, c.Email AS CustomerEmail
        FROM shop_orders o LEFT JOIN customers c ON o.CustomerID = c.CustomerID
        WHERE o.OrderID IN (SELECT OrderID FROM order_details)""")
_add("order_details", "OrderID:n BookID:n Quantity:n Price:d Title:s Author:s BookPrice:d",
     """SELECT od.*, b.Title, b.Author, b.Price AS BookPrice
        FROM order_details od LEFT JOIN books b ON od.BookID = b.BookID
        WHERE od.OrderID IN (SELECT OrderID FROM shop_orders)""")
_add("order_date_range", _ORDER + " CustomerName:s TotalItems:n",
     """SELECT o.*, c.Name AS CustomerName, count(od.BookID) AS TotalItems
        FROM shop_orders o LEFT JOIN customers c ON o.CustomerID = c.CustomerID
          LEFT JOIN order_details od ON o.OrderID = od.OrderID
        WHERE o.OrderDate BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY ALL""")
_add("order_stats", "TotalOrders:n TotalRevenue:d AverageOrderValue:d UniqueCustomers:n",
     f"""SELECT count(*) AS TotalOrders, coalesce(sum(TotalAmount), 0) AS TotalRevenue,
           {_avg("TotalAmount")} AS AverageOrderValue, count(DISTINCT CustomerID) AS UniqueCustomers
         FROM shop_orders""")
_add("order_line_totals", "OrderID:n BookID:n Quantity:n Price:d LineTotal:d",
     "SELECT *, Quantity * Price AS LineTotal FROM order_details")
_SUBTOTALS = """SELECT OrderID, sum(Quantity * Price) AS SubTotal FROM order_details
     WHERE BookID <> 0 AND Quantity > 0 GROUP BY 1"""
_add("order_subtotal", "OrderID:n SubTotal:d", _SUBTOTALS)
_add("order_total", "OrderID:n SubTotal:d DiscountAmount:d Total:d",
     f"""SELECT o.OrderID, coalesce(s.SubTotal, 0) AS SubTotal, DiscountAmount,
           coalesce(s.SubTotal, 0) - DiscountAmount AS Total
         FROM shop_orders o LEFT JOIN ({_SUBTOTALS}) s ON o.OrderID = s.OrderID""")
_add("stock_shortfall", "OrderID:n BookID:n Quantity:n Title:s Stock:n",
     """SELECT od.OrderID, od.BookID, od.Quantity, b.Title, coalesce(b.Stock, 0) AS Stock
        FROM order_details od LEFT JOIN books b ON od.BookID = b.BookID
        WHERE od.BookID <> 0 AND od.Quantity > coalesce(b.Stock, 0)""")
_add("pay_methods_active",
     "PaymentMethodID:x MethodName:s Description:s IsActive:b CreatedAt:T",
     """SELECT DISTINCT CAST(left(o_orderpriority, 1) AS INT) AS PaymentMethodID,
          substr(o_orderpriority, 3) AS MethodName, o_orderpriority AS Description,
          TRUE AS IsActive, TIMESTAMP '2024-01-01 00:00:00' AS CreatedAt
        FROM main.orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""")
_add("pay_method_valid", "OrderID:n PaymentMethodID:x ValidMethod:b",
     """SELECT OrderID, PaymentMethodID,
          coalesce(PaymentMethodID IN (SELECT PaymentMethodID FROM payment_methods), FALSE) AS ValidMethod
        FROM request_headers""")
_PAY = f"""SELECT pm.MethodName, count(o.OrderID) AS order_count, sum(o.TotalAmount) AS total_amount,
       {_avg("o.TotalAmount")} AS avg_amount
     FROM shop_orders o JOIN payment_methods pm ON o.PaymentMethodID = pm.PaymentMethodID
     {{where}} GROUP BY 1"""
_PAY_COLUMNS = "MethodName:s order_count:n total_amount:d avg_amount:d"
_add("pay_stats", _PAY_COLUMNS, _PAY.format(where=""))
_add("pay_stats_range", _PAY_COLUMNS, _PAY.format(
    where="WHERE o.OrderDate BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"))
_add("pay_orders_by_status", _ORDER + " CustomerName:s MethodName:s",
     """SELECT o.*, c.Name AS CustomerName, pm.MethodName
        FROM shop_orders o JOIN customers c ON o.CustomerID = c.CustomerID
          LEFT JOIN payment_methods pm ON o.PaymentMethodID = pm.PaymentMethodID
        WHERE o.PaymentStatus = 'paid'""")
_add("pay_usage", "MethodName:s usage_count:n total_revenue:d",
     """SELECT pm.MethodName, count(o.OrderID) AS usage_count, sum(o.TotalAmount) AS total_revenue
        FROM payment_methods pm LEFT JOIN shop_orders o
          ON pm.PaymentMethodID = o.PaymentMethodID AND o.PaymentStatus = 'paid' GROUP BY 1""")

# --- promotions ------------------------------------------------------------

_PROMOTION = ("PromotionID:x PromotionCode:s PromotionName:s Description:s DiscountType:s "
              "DiscountValue:d MinimumOrderAmount:d MaximumDiscount:d StartDate:t EndDate:t "
              "IsActive:b UsageLimit:x UsedCount:n CreatedAt:T UpdatedAt:T")
_LABELLED = "SELECT p.*, pt.TypeName FROM usable p LEFT JOIN promotion_types pt ON p.PromotionID = pt.TypeID"
_add("promo_active", _PROMOTION + " TypeName:s", _LABELLED)
_add("promo_by_code", _PROMOTION + " TypeName:s",
     _LABELLED + " WHERE upper(p.PromotionCode) IN (SELECT upper(PromotionCode) FROM request_headers)")
_add("promo_history",
     "UsageID:n PromotionID:x OrderID:n CustomerID:x DiscountAmount:d UsedAt:T PromotionCode:s "
     "PromotionName:s OrderDate:t",
     """SELECT pu.*, p.PromotionCode, p.PromotionName, o.OrderDate
        FROM promotion_usage pu JOIN promotions p ON pu.PromotionID = p.PromotionID
          JOIN shop_orders o ON pu.OrderID = o.OrderID
        WHERE pu.CustomerID IN (SELECT CustomerID FROM customers)""")
_add("promo_new_customers", _CUSTOMER,
     "SELECT * FROM customers WHERE CustomerID NOT IN (SELECT CustomerID FROM shop_orders)")
_add("promo_loyal_customers", _CUSTOMER + " OrderCount:n",
     """SELECT c.*, count(*) AS OrderCount FROM customers c JOIN shop_orders o USING (CustomerID)
        GROUP BY ALL HAVING count(*) >= 3""")
_SHOWN = "SELECT *, coalesce(CAST(UsageLimit AS VARCHAR), '∞') AS UsageLimitDisplay FROM promotions"
_add("promo_list", _PROMOTION + " UsageLimitDisplay:s", _SHOWN)
_add("promo_search", _PROMOTION + " UsageLimitDisplay:s",
     _SHOWN + """ WHERE PromotionCode ILIKE '%blue%' OR PromotionName ILIKE '%blue%'
                  OR Description ILIKE '%blue%'""")


def _discount(amount: str) -> str:
    """Discount in exact decimals from DiscountType, DiscountValue and MaximumDiscount."""
    share = (f"CAST({amount} AS DECIMAL(15,2)) * CAST(DiscountValue AS DECIMAL(12,2)) "
             "* CAST(0.01 AS DECIMAL(3,2))")
    return f"""CAST(least(CASE
        WHEN DiscountType = 'percentage' AND MaximumDiscount <> 0 THEN least({share}, MaximumDiscount)
        WHEN DiscountType = 'percentage' THEN {share}
        ELSE DiscountValue END, {amount}) AS DECIMAL(18,2))"""


_add("promo_discount", "OrderID:n SubTotal:d DiscountAmount:d",
     f"""SELECT OrderID, SubTotal, {_discount("SubTotal")} AS DiscountAmount
         FROM (SELECT OrderID, SubTotal, PromotionID FROM shop_orders) JOIN promotions USING (PromotionID)""")
_add("promo_use_counts", "PromotionID:x UsedCount:n",
     """SELECT PromotionID, UsedCount + (SELECT count(*) FROM shop_orders o
          WHERE o.PromotionID = p.PromotionID) AS UsedCount FROM promotions p""")
_add("promo_use_rows",
     "UsageID:n PromotionID:x OrderID:n CustomerID:x DiscountAmount:d UsedAt:T",
     """SELECT UsageID, PromotionID, OrderID, CustomerID, DiscountAmount,
          TIMESTAMP '2024-06-15 12:00:00' AS UsedAt FROM promotion_usage""")

# A target walk decided step by step: the lowest target that passes or fails at once.
_TARGET_WALK = """
  steps AS (
    SELECT a.OrderID, t.TargetID,
      CASE WHEN TargetType = 'all' THEN 'pass'
           WHEN TargetType = 'customer' AND TargetID_Value <> 0 AND TargetID_Value <> a.CustomerID THEN 'fail'
           WHEN TargetType = 'product' AND TargetID_Value <> 0 AND NOT EXISTS (
             SELECT 1 FROM request_lines l WHERE l.OrderID = a.OrderID AND l.BookID = TargetID_Value)
             THEN 'fail' END AS step
    FROM asked a JOIN promotion_targets t ON a.PromotionID = t.PromotionID),
  misaimed AS (
    SELECT OrderID FROM steps WHERE step IS NOT NULL
    GROUP BY OrderID HAVING arg_min(step, TargetID) = 'fail'),
"""
_ASKED = """
  uses AS (
    SELECT OrderID, CustomerID, PromotionCode, TotalAmount AS SubTotal FROM request_headers
    WHERE PromotionCode <> ''),
"""
_add("promo_targets", "OrderID:n", "SELECT OrderID FROM misaimed",
     _ASKED + """
  asked AS (
    SELECT u.OrderID, u.CustomerID, p.PromotionID FROM uses u
    JOIN promotions p ON upper(p.PromotionCode) = u.PromotionCode),
""" + _TARGET_WALK)

_USABLE_ASKED = """
  asked AS (
    SELECT u.OrderID, u.CustomerID, p.PromotionID FROM uses u
    JOIN usable p ON upper(p.PromotionCode) = upper(u.PromotionCode)),
""" + _TARGET_WALK
_PROMOTION_REASON = """CASE
      WHEN p.PromotionID IS NULL THEN 'unknown_or_inactive'
      WHEN u.SubTotal < p.MinimumOrderAmount THEN 'below_minimum'
      WHEN EXISTS (SELECT 1 FROM promotion_usage pu
                   WHERE pu.PromotionID = p.PromotionID AND pu.CustomerID = u.CustomerID) THEN 'already_used'
      WHEN u.OrderID IN (SELECT OrderID FROM misaimed) THEN 'not_targeted' END"""
_add("promo_validate", "OrderID:n PromotionReason:s",
     f"""SELECT u.OrderID, {_PROMOTION_REASON} AS PromotionReason
         FROM uses u LEFT JOIN usable p ON upper(p.PromotionCode) = upper(u.PromotionCode)""",
     _ASKED + _USABLE_ASKED)

# --- checks on incoming rows ------------------------------------------------

_add("validate_books", "BookID:n Reason:s",
     """SELECT p_partkey AS BookID, CASE p_size WHEN 1 THEN 'title_missing' WHEN 2 THEN 'author_missing'
          WHEN 3 THEN 'genre_missing' WHEN 4 THEN 'bad_price' WHEN 5 THEN 'bad_price'
          WHEN 6 THEN 'bad_input_quantity' WHEN 7 THEN 'bad_output_quantity' WHEN 8 THEN 'bad_stock'
          WHEN 9 THEN 'supplier_missing' WHEN 10 THEN 'supplier_missing' END AS Reason FROM part""")
_add("validate_customers", "RequestID:n Reason:s",
     """SELECT c_custkey AS RequestID, CASE c_nationkey WHEN 0 THEN 'name_missing'
          WHEN 1 THEN 'email_missing' WHEN 2 THEN 'bad_email' WHEN 3 THEN 'phone_missing'
          WHEN 4 THEN 'bad_phone' WHEN 5 THEN 'bad_phone' END AS Reason FROM customer""")
_add("validate_suppliers", "RequestID:n Reason:s",
     """SELECT s_suppkey AS RequestID, CASE s_nationkey WHEN 0 THEN 'name_missing'
          WHEN 1 THEN 'address_missing' WHEN 2 THEN 'phone_missing' WHEN 3 THEN 'bad_phone' END AS Reason
        FROM supplier""")
_add("validate_promotions", "RequestID:n Reason:s",
     """SELECT p_partkey AS RequestID, CASE p_size WHEN 1 THEN 'code_missing' WHEN 2 THEN 'name_missing'
          WHEN 3 THEN 'bad_type' WHEN 4 THEN 'bad_value' WHEN 5 THEN 'bad_value'
          WHEN 6 THEN CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'SMALL') THEN 'percentage_above_100' END
          WHEN 7 THEN 'dates_missing' WHEN 8 THEN 'bad_start_format' WHEN 9 THEN 'bad_start'
          WHEN 10 THEN 'dates_missing' WHEN 11 THEN 'bad_end_format' WHEN 12 THEN 'bad_end'
          WHEN 13 THEN 'end_not_after_start' WHEN 14 THEN 'end_not_after_start' END AS Reason
        FROM part""")
_LINE_FAULT = """CASE WHEN BookID = 0 THEN 'item_without_book' WHEN {q} <= 0 THEN 'bad_item_quantity'
           WHEN {p} <= 0 THEN 'bad_item_price' END"""
_FAULT_RANK = """CASE fault WHEN 'item_without_book' THEN 1 WHEN 'bad_item_quantity' THEN 2
           WHEN 'bad_item_price' THEN 3 END"""
_add("validate_orders", "OrderID:n Reason:s",
     f"""SELECT h.OrderID, CASE WHEN h.CustomerID = 0 THEN 'customer_missing'
           WHEN h.PaymentMethodID = 9 THEN 'date_missing' WHEN h.TotalAmount - 20000 <= 0 THEN 'bad_total'
           WHEN h.OrderID NOT IN (SELECT OrderID FROM request_lines) THEN 'no_items'
           ELSE f.fault END AS Reason
         FROM request_headers h LEFT JOIN first_fault f ON h.OrderID = f.OrderID""",
     f"""
  faults AS (
    SELECT OrderID, Position, {_LINE_FAULT.format(q="Quantity - 1", p="Price - 1500")} AS fault
    FROM request_lines),
  first_fault AS (
    SELECT OrderID, fault FROM faults WHERE fault IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY OrderID ORDER BY Position, {_FAULT_RANK}) = 1),
""")


def _unique(batch: str, stored: str, key: str, value: str) -> str:
    """Conflict of each row of ``batch`` looked up row by row."""
    return f"""SELECT r.RequestID, CASE
        WHEN EXISTS (SELECT 1 FROM {stored} b WHERE lower(b.{value}) = lower(r.{value})
                     AND b.{key} <> coalesce(r.{key}, -1)) THEN '{value}_taken'
        WHEN EXISTS (SELECT 1 FROM {batch} e WHERE lower(e.{value}) = lower(r.{value})
                     AND e.RequestID < r.RequestID) THEN '{value}_repeated' END AS Reason
      FROM {batch} r"""


_add("unique_customer_email", "RequestID:n Reason:s",
     _unique("batch", "customers", "CustomerID", "Email"), """
  batch AS (
    SELECT c_custkey AS RequestID, CASE WHEN c_nationkey <> 6 THEN c_custkey END AS CustomerID,
      CASE c_nationkey WHEN 1 THEN NULL WHEN 2 THEN 'no-at-sign'
           WHEN 7 THEN 'shared@' || lower(c_mktsegment) || '.example' ELSE Email END AS Email
    FROM customer c JOIN customers s ON s.CustomerID = c.c_custkey),
""")
_add("unique_supplier_phone", "RequestID:n Reason:s",
     _unique("batch", "suppliers", "SupplierID", "Phone"), """
  batch AS (
    SELECT s_suppkey AS RequestID, CASE WHEN s_nationkey <> 4 THEN s_suppkey END AS SupplierID,
      CASE s_nationkey WHEN 2 THEN NULL WHEN 3 THEN 'x123' WHEN 5 THEN '0999999999'
           ELSE CAST(20000000000 + s_suppkey AS VARCHAR) END AS Phone
    FROM supplier),
""")
_add("unique_promotion_code", "RequestID:n Reason:s",
     _unique("batch", "promotions", "PromotionID", "PromotionCode"), """
  batch AS (
    SELECT p_partkey AS RequestID, CASE WHEN p_size <> 20 THEN p_partkey + 5 END AS PromotionID,
      CASE p_size WHEN 1 THEN '' WHEN 21 THEN 'SPRING' ELSE 'BOOK' || p_partkey END AS PromotionCode
    FROM part),
""")


def _delete(name: str, table: str, key: str, column: str, base: str, references: str, kind: str = "n"):
    _add(name, f"{column}:{kind} Outcome:s",
         f"""SELECT 2 * {key} AS {column}, CASE
               WHEN 2 * {key} IN (SELECT {column} FROM {references} WHERE {column} IS NOT NULL) THEN 'in_use'
               WHEN 2 * {key} IN (SELECT {column} FROM {base}) THEN 'deleted' ELSE 'unknown' END AS Outcome
             FROM {table}""")


_delete("delete_books", "part", "p_partkey", "BookID", "books", "order_details")
_delete("delete_customers", "customer", "c_custkey", "CustomerID", "customers", "shop_orders", "x")
_delete("delete_suppliers", "supplier", "s_suppkey", "SupplierID", "suppliers", "books", "x")
_delete("delete_promotions", "part", "p_partkey", "PromotionID", "promotions", "promotion_usage", "x")

# --- state after changes ----------------------------------------------------

FAR = 1_000_000_000_000


def _merged(base: str, key: str, changed: str, kept: dict[str, str], columns: str) -> str:
    """Stored rows no change names, then the last change of each key."""
    names = [item.split(":")[0] for item in columns.split()]
    new = ", ".join(kept.get(n, f"c.{n}") + f" AS {n}" for n in names)
    old = ", ".join(names)
    return f"""SELECT {old} FROM {base} ANTI JOIN {changed} USING ({key})
      UNION ALL SELECT {new} FROM {changed} c LEFT JOIN {base} b ON b.{key} = c.{key}"""


_add("upsert_books", _BOOK, _merged("books", "BookID", "changed", {}, _BOOK), f"""
  keyed AS (
    SELECT *, l_partkey + CASE WHEN l_returnflag = 'A' THEN {FAR} ELSE 0 END AS k FROM lineitem),
  lines AS (
    SELECT * FROM keyed
    QUALIFY row_number() OVER (PARTITION BY keyed.k ORDER BY l_shipdate DESC, l_orderkey DESC,
      l_extendedprice DESC, l_quantity DESC, l_suppkey DESC, l_returnflag DESC, l_linestatus DESC) = 1),
  changed AS (
    SELECT k AS BookID, 'Title ' || l_suppkey AS Title, l_returnflag AS Author, l_linestatus AS Genre,
      CAST(l_extendedprice AS DECIMAL(18,2)) AS Price,
      CASE WHEN l_linestatus = 'F' THEN 2 * l_quantity - 1 ELSE l_quantity END AS Stock,
      CASE WHEN l_linestatus = 'F' THEN 2 * l_quantity ELSE l_quantity END AS InputQuantity,
      CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS OutputQuantity, l_suppkey AS SupplierID
    FROM lines),
""")
_add("upsert_customers", _CUSTOMER, _merged("customers", "CustomerID", "changed", {}, _CUSTOMER), f"""
  changed AS (
    SELECT o_custkey + CASE WHEN o_orderstatus = 'P' THEN {FAR} ELSE 0 END AS CustomerID,
      'Name ' || o_orderkey AS Name,
      CASE WHEN o_orderstatus <> 'O' THEN lower(o_orderpriority) END AS Email,
      CAST(o_orderkey AS VARCHAR) AS Phone
    FROM main.orders
    QUALIFY row_number() OVER (
        PARTITION BY o_custkey + CASE WHEN o_orderstatus = 'P' THEN {FAR} ELSE 0 END
        ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
""")
_add("upsert_suppliers", _SUPPLIER, _merged("suppliers", "SupplierID", "changed", {}, _SUPPLIER), f"""
  changed AS (
    SELECT l_suppkey + CASE WHEN l_returnflag = 'A' THEN {FAR} ELSE 0 END AS SupplierID,
      'Name ' || l_orderkey AS Name, CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS Address,
      CAST(l_partkey AS VARCHAR) AS Phone
    FROM lineitem
    QUALIFY row_number() OVER (
      PARTITION BY l_suppkey + CASE WHEN l_returnflag = 'A' THEN {FAR} ELSE 0 END
      ORDER BY l_shipdate DESC, l_orderkey DESC, l_extendedprice DESC, l_quantity DESC,
        l_partkey DESC, l_linestatus DESC, l_returnflag DESC) = 1),
""")
_add("upsert_promotions", _PROMOTION, _merged(
    "promotions", "PromotionID", "changed",
    {"UsedCount": "coalesce(b.UsedCount, 0)", "CreatedAt": "coalesce(b.CreatedAt, c.UpdatedAt)"},
    _PROMOTION), f"""
  changed AS (
    SELECT PromotionID + CASE WHEN MinimumOrderAmount > 45000 THEN {FAR} ELSE 0 END AS PromotionID,
      PromotionCode, PromotionName, Description, DiscountType, DiscountValue + 1 AS DiscountValue,
      MinimumOrderAmount, CAST(NULL AS DECIMAL(18,2)) AS MaximumDiscount, StartDate,
      EndDate + 30 AS EndDate, IsActive, UsageLimit, TIMESTAMP '2024-06-15 12:00:00' AS UpdatedAt
    FROM promotions WHERE PromotionID > 4),
""")
_add("update_orders", _ORDER,
     """SELECT o.* REPLACE (
          CASE WHEN c.OrderID IS NULL THEN o.CustomerID ELSE c.CustomerID END AS CustomerID,
          CASE WHEN c.OrderID IS NULL THEN o.OrderDate ELSE c.OrderDate END AS OrderDate,
          CASE WHEN c.OrderID IS NULL THEN o.TotalAmount ELSE c.TotalAmount END AS TotalAmount)
        FROM shop_orders o LEFT JOIN changed c ON o.OrderID = c.OrderID""", f"""
  changed AS (
    SELECT l_orderkey + CASE WHEN l_returnflag = 'N' THEN {FAR} ELSE 0 END AS OrderID,
      l_suppkey AS CustomerID, CAST(l_shipdate AS DATE) AS OrderDate,
      CAST(l_extendedprice AS DECIMAL(18,2)) AS TotalAmount
    FROM lineitem
    QUALIFY row_number() OVER (
      PARTITION BY l_orderkey + CASE WHEN l_returnflag = 'N' THEN {FAR} ELSE 0 END
      ORDER BY l_shipdate DESC, l_extendedprice DESC, l_suppkey DESC) = 1),
""")

_PRICED_CTES = """
  line_faults AS (
    SELECT OrderID, Position, """ + _LINE_FAULT.format(q="Quantity", p="Price") + """ AS fault
    FROM request_lines),
  first_fault AS (
    SELECT OrderID, fault FROM line_faults WHERE fault IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY OrderID ORDER BY Position, """ + _FAULT_RANK + """) = 1),
  amounts AS (
    SELECT h.*, CAST(coalesce((SELECT sum(l.Quantity * l.Price) FROM request_lines l
        WHERE l.OrderID = h.OrderID AND l.BookID <> 0 AND l.Quantity > 0), 0) AS DECIMAL(18,2)) AS SubTotal,
      CASE WHEN h.CustomerID = 0 THEN 'customer_missing' WHEN h.TotalAmount <= 0 THEN 'bad_total'
           WHEN h.OrderID NOT IN (SELECT OrderID FROM request_lines) THEN 'no_items'
           ELSE f.fault END AS header_reason
    FROM request_headers h LEFT JOIN first_fault f ON h.OrderID = f.OrderID),
  uses AS (SELECT OrderID, CustomerID, PromotionCode, SubTotal FROM amounts),
""" + _USABLE_ASKED + f"""
  checked AS (
    SELECT u.*, p.PromotionID, p.DiscountType, p.DiscountValue, p.MaximumDiscount,
      p.UsageLimit, p.UsedCount,
      CASE WHEN u.PromotionCode <> '' THEN {_PROMOTION_REASON} END AS PromotionReason
    FROM amounts u LEFT JOIN usable p ON upper(p.PromotionCode) = upper(u.PromotionCode)),
  priced AS (
    SELECT *, coalesce(header_reason,
        CASE WHEN PromotionReason IS NOT NULL THEN 'promotion_refused'
             WHEN PaymentMethodID NOT IN (SELECT PaymentMethodID FROM payment_methods)
               THEN 'bad_payment_method' END) AS Reason,
      CASE WHEN PromotionID IS NULL THEN 0 ELSE {_discount("SubTotal")} END AS DiscountAmount
    FROM checked),
"""
_add("price_orders",
     "OrderID:n CustomerID:x OrderDate:s PaymentMethodID:x PromotionID:x SubTotal:d DiscountAmount:d "
     "TotalAmount:d PaymentStatus:s PromotionReason:s Reason:s",
     """SELECT * EXCLUDE (TotalAmount), SubTotal - DiscountAmount AS TotalAmount,
          'pending' AS PaymentStatus FROM priced""", _PRICED_CTES)

_SOLD = "(SELECT coalesce(sum(Quantity), 0) FROM order_details od WHERE od.BookID = b.BookID)"
_LEDGER = f"""SELECT BookID, Stock, InputQuantity, OutputQuantity, {_SOLD} AS Sold,
       InputQuantity - {_SOLD} AS LedgerStock, Stock - (InputQuantity - {_SOLD}) AS Drift FROM books b"""
_LEDGER_COLUMNS = "BookID:n Stock:n InputQuantity:n OutputQuantity:n Sold:n LedgerStock:n Drift:n"
_add("stock_ledger", _LEDGER_COLUMNS, _LEDGER)
_add("stock_drift", _LEDGER_COLUMNS, f"SELECT * FROM ({_LEDGER}) WHERE Drift <> 0")
_RECONCILED = f"""SELECT * REPLACE (Stock + {_SOLD} AS InputQuantity, {_SOLD} AS OutputQuantity)
     FROM books b"""
_add("reconcile_books", _BOOK, _RECONCILED)
_add("adjust_stock", _BOOK,
     """SELECT * REPLACE (Stock + coalesce((SELECT sum(CASE l_returnflag WHEN 'R' THEN l_quantity
          ELSE -l_quantity END) FROM lineitem WHERE l_partkey = BookID), 0) AS Stock) FROM books""")

_CANCELS = f"""
  asked AS (
    SELECT o_orderkey AS OrderID FROM main.orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT -1 - c_custkey FROM customer),
  outcomes AS (
    SELECT OrderID, CASE WHEN OrderID NOT IN (SELECT OrderID FROM shop_orders) THEN 'unknown'
        WHEN OrderID IN (SELECT OrderID FROM promotion_usage) THEN 'has_promotion_usage'
        ELSE 'cancelled' END AS Outcome FROM asked),
  gone AS (SELECT OrderID FROM outcomes WHERE Outcome = 'cancelled'),
  reconciled AS ({_RECONCILED}),
"""
_RETURNED = """coalesce((SELECT sum(Quantity) FROM order_details od
     WHERE od.BookID = r.BookID AND od.OrderID IN (SELECT OrderID FROM gone)), 0)"""
_add("cancel_outcomes", "OrderID:n Outcome:s", "SELECT * FROM outcomes", _CANCELS)
_add("cancel_orders_left", _ORDER,
     "SELECT * FROM shop_orders WHERE OrderID NOT IN (SELECT OrderID FROM gone)", _CANCELS)
_add("cancel_lines_left", "OrderID:n BookID:n Quantity:n Price:d",
     "SELECT * FROM order_details WHERE OrderID NOT IN (SELECT OrderID FROM gone)", _CANCELS)
_add("cancel_stock", _BOOK,
     f"""SELECT * REPLACE (OutputQuantity - {_RETURNED} AS OutputQuantity,
           InputQuantity - (OutputQuantity - {_RETURNED}) AS Stock) FROM reconciled r""", _CANCELS)

_PAYMENTS = """
  steps AS (
    SELECT *, CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'error' THEN 'failed'
        WHEN 'signup' THEN 'refunded' ELSE 'pending' END AS status,
      CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 5 END AS method FROM events),
  last_step AS (
    SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
  last_paid AS (SELECT user_id, max(ts) AS at FROM steps WHERE status = 'paid' GROUP BY 1),
  last_method AS (
    SELECT * FROM steps WHERE method IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
"""
_PAID_ORDERS = """SELECT o.* REPLACE (
       CASE WHEN l.user_id IS NULL THEN o.PaymentStatus ELSE l.status END AS PaymentStatus,
       CASE WHEN l.user_id IS NULL THEN o.TransactionID ELSE l.props END AS TransactionID,
       coalesce(p.at, o.PaymentDate) AS PaymentDate,
       coalesce(m.method, o.PaymentMethodID) AS PaymentMethodID)
     FROM shop_orders o LEFT JOIN last_step l ON l.user_id = o.OrderID
       LEFT JOIN last_paid p ON p.user_id = o.OrderID LEFT JOIN last_method m ON m.user_id = o.OrderID"""
_add("apply_payments", _ORDER, _PAID_ORDERS, _PAYMENTS)
_add("stream_payment_state", _ORDER, _PAID_ORDERS, _PAYMENTS)
_add("backfill_orders", _ORDER,
     """SELECT * REPLACE (
          CASE WHEN PaymentMethodID IS NULL THEN TotalAmount ELSE SubTotal END AS SubTotal,
          CASE WHEN PaymentMethodID IS NULL THEN 'paid' ELSE PaymentStatus END AS PaymentStatus,
          CASE WHEN PaymentMethodID IS NULL THEN CAST(OrderDate AS TIMESTAMP) ELSE PaymentDate END AS PaymentDate,
          coalesce(PaymentMethodID, 1) AS PaymentMethodID)
        FROM shop_orders""")
_add("replace_targets", "TargetID:n PromotionID:x TargetType:s TargetID_Value:x",
     f"""SELECT * FROM promotion_targets
         WHERE PromotionID NOT IN (SELECT p_partkey + 5 FROM part WHERE p_size <= 25)
         UNION ALL SELECT {FAR} + p_partkey + 5, p_partkey + 5, 'product', p_partkey
         FROM part WHERE p_size <= 25 AND p_type <> 'LARGE'""")
_add("stream_sales_trends", "Date:s DailyOrders:n DailyRevenue:d AverageOrderValue:d",
     """SELECT strftime(ts, '%Y-%m-%d') AS Date, count(*) AS DailyOrders,
          sum(amount) AS DailyRevenue, round(CAST(sum(amount) AS DOUBLE) / count(*), 6) AS AverageOrderValue
        FROM (SELECT ts, CAST(value AS DECIMAL(18,2)) AS amount FROM events WHERE event_type = 'purchase')
        GROUP BY 1""")

# Serving one by one, literally: a recursion over the orders that carries the stock of all
# books, the promotions used and the (promotion, customer) pairs that used them.
_SERVED = _PRICED_CTES + """
  repeated AS (SELECT DISTINCT OrderID FROM request_lines GROUP BY OrderID, BookID HAVING count(*) > 1),
  shelf AS (SELECT BookID, row_number() OVER (ORDER BY BookID) AS slot FROM books),
  needs AS (
    SELECT OrderID, map_from_entries(list((slot, Quantity))) AS need, bool_or(slot IS NULL) AS unknown_book
    FROM request_lines LEFT JOIN shelf USING (BookID)
    WHERE OrderID NOT IN (SELECT OrderID FROM repeated) GROUP BY OrderID),
  queue AS MATERIALIZED (
    SELECT p.OrderID, p.CustomerID, p.PromotionID, p.UsageLimit - p.UsedCount AS uses_left, need,
      unknown_book, row_number() OVER (ORDER BY p.OrderID) AS turn
    FROM priced p JOIN needs n ON n.OrderID = p.OrderID
    WHERE p.Reason IS NULL AND p.OrderID NOT IN (SELECT OrderID FROM repeated)),
  served AS (
    SELECT CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS OrderID, CAST(NULL AS VARCHAR) AS fate,
      (SELECT list(Stock ORDER BY BookID) FROM books) AS stock,
      CAST([] AS BIGINT[]) AS promos, CAST([] AS VARCHAR[]) AS pairs
    UNION ALL
    SELECT turn, OrderID, fate,
      CASE WHEN fate IS NULL THEN list_transform(stock, lambda s, i: s - coalesce(need[i], 0)) ELSE stock END,
      CASE WHEN fate IS NULL AND PromotionID IS NOT NULL THEN list_append(promos, PromotionID) ELSE promos END,
      CASE WHEN fate IS NULL AND PromotionID IS NOT NULL
           THEN list_append(pairs, PromotionID || '-' || CustomerID) ELSE pairs END
    FROM (
      SELECT q.*, s.stock, s.promos, s.pairs, CASE
        WHEN len(list_filter(s.promos, lambda p: p = q.PromotionID)) >= q.uses_left THEN 'promotion_exhausted'
        WHEN list_contains(s.pairs, q.PromotionID || '-' || q.CustomerID) THEN 'already_used'
        WHEN q.unknown_book OR len(list_filter(map_entries(q.need), lambda e: e.value > s.stock[e.key])) > 0
          THEN 'insufficient_stock' END AS fate
      FROM served s JOIN queue q ON q.turn = s.turn + 1)),
"""
_add("take_orders", "OrderID:n Accepted:b Reason:s",
     """SELECT p.OrderID, s.OrderID IS NOT NULL AND s.fate IS NULL AS Accepted,
          CASE WHEN p.Reason IS NOT NULL THEN p.Reason
               WHEN p.OrderID IN (SELECT OrderID FROM repeated) THEN 'repeated_book'
               ELSE s.fate END AS Reason
        FROM priced p LEFT JOIN served s ON s.OrderID = p.OrderID""", _SERVED)
_add("take_orders_stock", _BOOK,
     """SELECT * REPLACE (OutputQuantity + sold AS OutputQuantity,
          InputQuantity - OutputQuantity - sold AS Stock)
        FROM (SELECT b.*, coalesce((SELECT sum(l.Quantity) FROM request_lines l
                JOIN served s ON s.OrderID = l.OrderID AND s.fate IS NULL
                WHERE l.BookID = b.BookID), 0) AS sold FROM books b)""", _SERVED)

# Constraints on what comes in, row by row.
def _lacks(column: str, table: str, key: str = "") -> str:
    return f"{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {table} r WHERE r.{key or column} = b.{column})"


_add("fk_orders", "OrderID:n Reason:s", f"""SELECT OrderID, CASE
       WHEN {_lacks("CustomerID", "customers")} THEN 'unknown_customer'
       WHEN {_lacks("PaymentMethodID", "payment_methods")} THEN 'unknown_payment_method'
       WHEN {_lacks("PromotionID", "promotions")} THEN 'unknown_promotion' END AS Reason
     FROM (SELECT s.* REPLACE (CASE WHEN o.o_orderpriority = '5-LOW' THEN 9 ELSE PaymentMethodID END AS PaymentMethodID)
           FROM shop_orders s JOIN main.orders o ON o.o_orderkey = s.OrderID) b""")
_add("fk_order_details", "OrderID:n Position:n Reason:s", f"""SELECT OrderID, Position, CASE
       WHEN {_lacks("OrderID", "shop_orders")} THEN 'unknown_order'
       WHEN {_lacks("BookID", "books")} THEN 'unknown_book' END AS Reason
     FROM (SELECT l_orderkey + CASE WHEN l_returnflag = 'A' THEN {FAR} ELSE 0 END AS OrderID, l_linenumber AS Position,
                  l_partkey + CASE WHEN l_quantity >= 45 THEN {FAR} ELSE 0 END AS BookID FROM lineitem) b""")
_add("fk_books", "BookID:n Reason:s",
     f"SELECT BookID, CASE WHEN {_lacks('SupplierID', 'suppliers')} THEN 'unknown_supplier' END AS Reason FROM books b")
_add("fk_targets", "TargetID:n Reason:s", f"""SELECT TargetID, CASE
       WHEN {_lacks("PromotionID", "promotions")} THEN 'unknown_promotion' END AS Reason
     FROM (SELECT p_partkey AS TargetID, 2 * p_partkey + 5 AS PromotionID FROM part) b""")
_add("fk_promotion_usage", "UsageID:n Reason:s", f"""SELECT UsageID, CASE
       WHEN {_lacks("PromotionID", "promotions")} THEN 'unknown_promotion'
       WHEN {_lacks("OrderID", "shop_orders")} THEN 'unknown_order'
       WHEN {_lacks("CustomerID", "customers")} THEN 'unknown_customer' END AS Reason
     FROM promotion_usage b""")

# Declared rules: table, its name here, key, and column, rule and what breaks it.
_BROKEN = {
    ("books", "books", "BookID"): [
        *((c, "width_100", f"length({c}) > 100") for c in ("Title", "Author", "Genre")),
        ("Price", "decimal_10_2", "abs(Price) >= 100000000"),
        *((c, "at_least_0", f"{c} < 0") for c in ("Stock", "InputQuantity", "OutputQuantity"))],
    ("customers", "customers", "CustomerID"): [
        ("Name", "width_50", "length(Name) > 50"), ("Email", "width_100", "length(Email) > 100"),
        ("Phone", "width_10", "length(Phone) > 10")],
    ("suppliers", "suppliers", "SupplierID"): [
        ("Name", "width_100", "length(Name) > 100"), ("Phone", "width_10", "length(Phone) > 10")],
    ("orders", "shop_orders", "OrderID"): [
        *((c, "decimal_10_2", f"abs({c}) >= 100000000") for c in ("SubTotal", "DiscountAmount", "TotalAmount")),
        ("PaymentStatus", "one_of", "PaymentStatus NOT IN ('pending', 'paid', 'failed', 'refunded')"),
        ("TransactionID", "width_100", "length(TransactionID) > 100")],
    ("order_details", "order_details", "OrderID"): [
        ("OrderID", "given", "OrderID IS NULL"), ("BookID", "given", "BookID IS NULL"),
        ("Quantity", "at_least_1", "Quantity < 1"), ("Price", "decimal_10_2", "abs(Price) >= 100000000")],
    ("promotions", "promotions", "PromotionID"): [
        *((c, "given", f"{c} IS NULL") for c in (
            "PromotionCode", "PromotionName", "DiscountType", "DiscountValue", "StartDate", "EndDate")),
        ("PromotionCode", "width_20", "length(PromotionCode) > 20"),
        ("PromotionName", "width_100", "length(PromotionName) > 100"),
        ("DiscountType", "one_of", "DiscountType NOT IN ('percentage', 'fixed_amount')"),
        *((c, "decimal_10_2", f"abs({c}) >= 100000000") for c in ("DiscountValue", "MinimumOrderAmount", "MaximumDiscount")),
        ("DiscountValue", "above_0", "DiscountValue <= 0"), ("EndDate", "not_before_start", "EndDate < StartDate"),
        ("UsageLimit", "above_0", "UsageLimit <= 0"), ("UsedCount", "at_least_0", "UsedCount < 0")],
    ("promotion_types", "promotion_types", "TypeID"): [
        ("TypeName", "given", "TypeName IS NULL"), ("TypeName", "width_50", "length(TypeName) > 50")],
    ("promotion_targets", "promotion_targets", "TargetID"): [
        ("PromotionID", "given", "PromotionID IS NULL"), ("TargetType", "given", "TargetType IS NULL"),
        ("TargetType", "one_of", "TargetType NOT IN ('product', 'customer', 'category', 'all')")],
    ("payment_methods", "payment_methods", "PaymentMethodID"): [
        ("MethodName", "given", "MethodName IS NULL"), ("MethodName", "width_50", "length(MethodName) > 50")],
    ("promotion_usage", "promotion_usage", "UsageID"): [
        *((c, "given", f"{c} IS NULL") for c in ("PromotionID", "OrderID", "CustomerID", "DiscountAmount")),
        ("DiscountAmount", "decimal_10_2", "abs(DiscountAmount) >= 100000000")],
}
_add("constraint_profile", "Table:s Column:s Rule:s Rows:n Violations:n FirstKey:x LastKey:x", " UNION ALL ".join(
    f"""SELECT '{table}' AS "Table", '{column}' AS "Column", '{rule}' AS "Rule",
        (SELECT count(*) FROM {name}) AS "Rows", count(*) AS Violations,
        min({key}) AS FirstKey, max({key}) AS LastKey FROM {name} WHERE {broken}"""
    for (table, name, key), rules in _BROKEN.items() for column, rule, broken in rules))

# Paid orders are delivered once more, others under a new number, pending ones twice; each number is served once.
_NEW = f"CASE WHEN o_orderstatus <> 'F' THEN {FAR} ELSE 0 END"
_DELIVERIES = (
    _REQUESTS.replace("request_headers AS (", "sent_headers AS (")
    .replace("SELECT o_orderkey AS OrderID,", f"SELECT o_orderkey + {_NEW} AS OrderID, o_orderstatus AS status,")
    .replace("request_lines AS (", "sent_lines AS (")
    .replace("SELECT l_orderkey AS OrderID,", f"SELECT l_orderkey + {_NEW} AS OrderID,")
    .replace("    FROM lineitem),", "    FROM lineitem JOIN main.orders ON o_orderkey = l_orderkey),")
) + """
  deliveries AS (
    SELECT *, 1 AS Delivery FROM sent_headers UNION ALL SELECT *, 2 FROM sent_headers WHERE status = 'P'),
  admitted AS (
    SELECT *, CASE WHEN OrderID IN (SELECT OrderID FROM shop_orders) THEN 'order_exists'
        WHEN Delivery > 1 THEN 'repeated_request'
        WHEN CustomerID NOT IN (SELECT CustomerID FROM customers) THEN 'unknown_customer' END AS refusal
    FROM deliveries),
  request_headers AS (
    SELECT OrderID, CustomerID, OrderDate, PromotionCode, PaymentMethodID, TotalAmount
    FROM admitted WHERE refusal IS NULL),
  request_lines AS (SELECT l.* FROM sent_lines l SEMI JOIN request_headers USING (OrderID)),
"""
_add("take_orders_replayed", "OrderID:n Delivery:n Accepted:b Reason:s",
     """SELECT a.OrderID, a.Delivery, a.refusal IS NULL AND s.OrderID IS NOT NULL AND s.fate IS NULL AS Accepted,
          CASE WHEN a.refusal IS NOT NULL THEN a.refusal WHEN p.Reason IS NOT NULL THEN p.Reason
               WHEN a.OrderID IN (SELECT OrderID FROM repeated) THEN 'repeated_book' ELSE s.fate END AS Reason
        FROM admitted a LEFT JOIN priced p ON p.OrderID = a.OrderID LEFT JOIN served s ON s.OrderID = a.OrderID""",
     _SERVED, _DELIVERIES)

for _name in ("take_orders", "take_orders_stock", "take_orders_replayed"):
    _ORACLES[_name] = _ORACLES[_name].replace("WITH", "WITH RECURSIVE", 1)
_add("read_requests", "event_id:n Reason:s Lines:n Quantity:n", """
     SELECT event_id, refusal AS Reason,
       CASE WHEN refusal IS NULL THEN json_array_length(Text, '$.items') ELSE 0 END AS Lines,
       CASE WHEN refusal IS NULL THEN list_sum(CAST(json_extract(Text, '$.items[*].Quantity') AS BIGINT[])) ELSE 0 END AS Quantity
     FROM judged""", """
  request_texts AS (
    SELECT event_id, CASE WHEN json_extract_string(props, '$.k') <> '13' THEN
      CASE WHEN event_type = 'error' THEN left(whole, length(whole) - 3) ELSE whole END END AS Text
    FROM (SELECT *, '{"OrderID":' || event_id || ',"CustomerID":' || user_id || ',"items":' || CASE event_type
        WHEN 'view' THEN 'null' WHEN 'click' THEN '[]'
        ELSE '[{"BookID":1,"Quantity":1},{"BookID":' || json_extract_string(props, '$.k') || ',"Quantity":'
             || CASE event_type WHEN 'signup' THEN '"two"' ELSE '2' END || '}]' END || '}' AS whole FROM events)),
  judged AS (
    SELECT *, CASE WHEN Text IS NULL THEN 'no_text' WHEN NOT json_valid(Text) THEN 'malformed'
      WHEN json_type(Text, '$.items') = 'NULL' THEN 'missing_items'
      WHEN json_array_length(Text, '$.items') = 0 THEN 'no_items'
      WHEN list_contains(json_type(Text, ['$.items[0].Quantity', '$.items[1].Quantity']), 'VARCHAR') THEN 'wrong_type'
      END AS refusal FROM request_texts),
""")
# Reports merged from the rollup are those made from orders.
for _name, _report in (
    ("monthly", "dash_monthly"), ("weekly", "rev_weekly"), ("yearly", "rev_yearly"), ("summary", "rev_summary"),
    ("customer_growth", "dash_customer_growth"), ("sales_trends", "dash_sales_trends"),
    ("sales_chart_day", "dash_sales_chart_day"), ("order_recency", "dash_order_recency"),
):
    _ORACLES[f"rollup_{_name}"] = _ORACLES[_report]
_add("rollup_refresh", "Day:t OrderCount:n Revenue:d UniqueCustomers:n",
     """SELECT OrderDate AS Day, count(*) AS OrderCount, coalesce(sum(TotalAmount), 0) AS Revenue,
          count(DISTINCT CustomerID) AS UniqueCustomers FROM shop_orders GROUP BY 1""")
_add("rollup_order_totals",
     "TotalOrders:n TotalRevenue:d ActiveCustomers:n OrdersThisMonth:n RevenueThisMonth:d",
     f"""SELECT count(*) AS TotalOrders, coalesce(sum(TotalAmount), 0) AS TotalRevenue,
          count(DISTINCT CustomerID) AS ActiveCustomers, count(*) FILTER (WHERE {_LAST_30}) AS OrdersThisMonth,
          coalesce(sum(TotalAmount) FILTER (WHERE {_LAST_30}), 0) AS RevenueThisMonth FROM shop_orders""")


# Bundles, value by value: each section is the report's own SQL, cut to its length and turned on its side.
def _values(name: str, sections: dict[str, tuple[str, str, str]]) -> None:
    """``sections``: the section's report, its key ('' for a single row), and how it is cut."""
    tables, parts = [], []
    for i, (section, (report, key, cut)) in enumerate(sections.items()):
        tables.append(f"s{i} AS MATERIALIZED (SELECT * FROM ({_ORACLES[report]}) {cut})")
        for column, kind in (item.split(":") for item in _COLUMNS[report].split()):
            number = f"CAST({column} AS DOUBLE)" if kind in "ndx" else "CAST(NULL AS DOUBLE)"
            text = "CAST(NULL AS VARCHAR)" if kind in "ndx" else f"CAST({column} AS VARCHAR)"
            parts.append(f"""SELECT '{section}' AS Section, {f'CAST({key} AS VARCHAR)' if key else "''"} AS "Key",
              '{column}' AS Name, {number} AS Number, {text} AS Text FROM s{i}""")
    _ORACLES[name] = f"WITH {', '.join(tables)} {' UNION ALL '.join(parts)}"


_BUNDLE = {
    "weekly": ("rev_weekly", "WeekNumber", ""), "monthly": ("rev_monthly", "Month", ""),
    "yearly": ("rev_yearly", "Year", ""), "summary": ("rev_summary", "", ""),
}
_DASHBOARD = {
    "overview": ("dash_overview", "", ""), "monthlyStats": ("dash_monthly", "Month", ""),
    "topBooks": ("dash_top_books", "BookID", ""), "topCustomers": ("dash_top_customers", "CustomerID", ""),
    "lowStockBooks": ("dash_low_stock", "BookID", ""), "genreStats": ("dash_genre", "Genre", ""),
    "supplierStats": ("dash_supplier", "SupplierID", ""), "inventoryStats": ("dash_inventory", "", ""),
    "customerGrowth": ("dash_customer_growth", "Month", ""), "salesTrends": ("dash_sales_trends", "Date", ""),
    "orderStatusStats": ("dash_order_recency", "Code", ""), "newBooksStats": ("dash_new_books", "", ""),
} | {f"revenueStats.{name}": section for name, section in _BUNDLE.items()}
_values("rev_bundle_values", _BUNDLE)
_values("dash_all_values", _DASHBOARD)
_values("export_report_values", {
    name: section for name, section in _DASHBOARD.items()
    if name in ("overview", "topBooks", "topCustomers", "lowStockBooks") or name.startswith("revenueStats.")})
_values("dash_top5_values", {
    "topBooks": ("dash_top_books", "BookID", "ORDER BY TotalSold DESC, TotalRevenue DESC, BookID LIMIT 5"),
    "topCustomers": ("dash_top_customers", "CustomerID", "ORDER BY TotalSpent DESC, OrderCount DESC, CustomerID LIMIT 5"),
    "lowStockBooks": ("dash_low_stock", "BookID", "ORDER BY Stock, BookID LIMIT 5"),
    "supplierStats": ("dash_supplier", "SupplierID", "ORDER BY TotalRevenue DESC, BookCount DESC, SupplierID LIMIT 5"),
    "genreStats": ("dash_genre", "Genre", "ORDER BY TotalRevenue DESC, TotalSold DESC, Genre LIMIT 5"),
    "monthlyStats": ("dash_monthly", "Month", "ORDER BY Month DESC LIMIT 6"),
})
_ORACLES["stream_validate_orders"] = _ORACLES["validate_orders"]
_ORACLES["stream_take_orders"] = _ORACLES["take_orders"]
_ORACLES["replay_validate_orders"] = _ORACLES["validate_orders"]
_ORACLES["replay_payment_state"] = _ORACLES["stream_payment_state"]
_ORACLES["replay_take_orders"] = _ORACLES["take_orders_replayed"]
# In append mode a day is out once the watermark, a day behind the last sale, has passed its end.
_add("replay_sales_trends", "Date:s DailyOrders:n DailyRevenue:d AverageOrderValue:d",
     """SELECT strftime(ts, '%Y-%m-%d') AS Date, count(*) AS DailyOrders,
          sum(amount) AS DailyRevenue, round(CAST(sum(amount) AS DOUBLE) / count(*), 6) AS AverageOrderValue
        FROM (SELECT ts, CAST(value AS DECIMAL(18,2)) AS amount FROM events WHERE event_type = 'purchase')
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <=
          (SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE event_type = 'purchase') GROUP BY 1""")
_add("replay_daily_buyers", "Date:s DailyCustomers:n",
     """SELECT strftime(ts, '%Y-%m-%d') AS Date, count(DISTINCT user_id) AS DailyCustomers
        FROM events WHERE event_type = 'purchase' GROUP BY 1""")
