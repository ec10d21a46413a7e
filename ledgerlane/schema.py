"""Declared schemas of the retail tables and the rows every shop starts with."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "money": MONEY,
}


def _struct(columns: str) -> T.StructType:
    """A schema from ``name type`` pairs; needs no running session."""
    pairs = (item.split() for item in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


BOOKS = _struct(
    "BookID long, Title string, Author string, Genre string, Price money, Stock int, "
    "InputQuantity long, OutputQuantity long, SupplierID long"
)
CUSTOMERS = _struct("CustomerID long, Name string, Email string, Phone string")
SUPPLIERS = _struct("SupplierID long, Name string, Address string, Phone string")
ORDERS = _struct(
    "OrderID long, CustomerID long, OrderDate date, SubTotal money, "
    "DiscountAmount money, TotalAmount money, PaymentMethodID int, "
    "PromotionID long, PaymentStatus string, PaymentDate timestamp, TransactionID string"
)
ORDER_DETAILS = _struct("OrderID long, BookID long, Quantity int, Price money")
PROMOTIONS = _struct(
    "PromotionID long, PromotionCode string, PromotionName string, Description string, "
    "DiscountType string, DiscountValue money, MinimumOrderAmount money, "
    "MaximumDiscount money, StartDate date, EndDate date, IsActive boolean, "
    "UsageLimit int, UsedCount int, CreatedAt timestamp, UpdatedAt timestamp"
)
PROMOTION_TYPES = _struct("TypeID int, TypeName string, Description string")
PROMOTION_TARGETS = _struct(
    "TargetID long, PromotionID long, TargetType string, TargetID_Value long"
)
PAYMENT_METHODS = _struct(
    "PaymentMethodID int, MethodName string, Description string, IsActive boolean, "
    "CreatedAt timestamp"
)
PROMOTION_USAGE = _struct(
    "UsageID long, PromotionID long, OrderID long, CustomerID long, "
    "DiscountAmount money, UsedAt timestamp"
)

SCHEMAS = {
    "books": BOOKS,
    "customers": CUSTOMERS,
    "suppliers": SUPPLIERS,
    "orders": ORDERS,
    "order_details": ORDER_DETAILS,
    "promotions": PROMOTIONS,
    "promotion_types": PROMOTION_TYPES,
    "promotion_targets": PROMOTION_TARGETS,
    "payment_methods": PAYMENT_METHODS,
    "promotion_usage": PROMOTION_USAGE,
}

#: One incoming order as the shop front sends it.
ORDER_REQUEST = _struct(
    "OrderID long, CustomerID long, OrderDate string, PromotionCode string, "
    "PaymentMethodID int, TotalAmount money"
).add("items", T.ArrayType(_struct("BookID long, Quantity int, Price money")))

# ---------------------------------------------------------------------------
# Allowed codes, limits and the rows a new shop is seeded with.
# ---------------------------------------------------------------------------
DISCOUNT_TYPES = ("percentage", "fixed_amount")
TARGET_TYPES = ("product", "customer", "category", "all")
PAYMENT_STATUSES = ("pending", "paid", "failed", "refunded")

LOW_STOCK = 5
HIGH_STOCK = 20
LOYAL_ORDERS = 3

PHONE_PATTERN = "^[0-9]{10,11}$"
DATE_PATTERN = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
EMAIL_LENGTH = 254

# Codes and display labels of the order recency report.
RECENCY_LABELS = (
    ("all", "Tổng đơn hàng"),
    ("last_30_days", "Đơn hàng tháng này"),
    ("last_7_days", "Đơn hàng tuần này"),
    ("today", "Đơn hàng hôm nay"),
)

SEED_PROMOTION_TYPES = (
    (1, "Product Discount", "Discount applied to specific products"),
    (2, "Customer Discount", "Discount applied to specific customers"),
    (3, "Category Discount", "Discount applied to product categories"),
    (4, "Order Discount", "Discount applied to entire order"),
    (5, "New Customer", "Discount for new customers"),
    (6, "Loyalty", "Discount for loyal customers"),
    (7, "Seasonal", "Seasonal promotions"),
    (8, "Flash Sale", "Limited time promotions"),
)

SEED_PAYMENT_METHODS = (
    (1, "Cash", "Thanh toán tiền mặt"),
    (2, "Bank Transfer", "Chuyển khoản ngân hàng"),
    (3, "Credit Card", "Thanh toán bằng thẻ tín dụng"),
    (4, "E-wallet", "Ví điện tử"),
    (5, "COD", "Thanh toán khi nhận hàng"),
)

# id, code, name, description, type, value, minimum, limit; all run through 2024.
SEED_PROMOTIONS = (
    (1, "WELCOME10", "Giảm giá 10% cho khách hàng mới",
     "Áp dụng cho đơn hàng đầu tiên", "percentage", "10.00", "100000.00", 100),
    (2, "SAVE20", "Giảm giá 20,000đ cho đơn hàng từ 200,000đ",
     "Áp dụng cho tất cả khách hàng", "fixed_amount", "20000.00", "200000.00", 50),
    (3, "BOOKSALE", "Giảm giá 15% cho sách văn học",
     "Áp dụng cho sách văn học", "percentage", "15.00", "50000.00", 200),
    (4, "LOYALTY5", "Giảm giá 5% cho khách hàng thân thiết",
     "Áp dụng cho khách hàng có từ 3 đơn hàng trở lên", "percentage", "5.00", "0.00", None),
)
SEED_PROMOTION_START = "2024-01-01"
SEED_PROMOTION_END = "2024-12-31"

# id, promotion, target type; none names a single target.
SEED_PROMOTION_TARGETS = (
    (1, 1, "customer"),
    (2, 2, "all"),
    (3, 3, "category"),
    (4, 4, "customer"),
)
