"""Adapter: the retail tables expressed over a part / customer / orders star schema.

Every logical table is a projection of one source table, so filters and column
pruning reach its scan.  Promotions and their targets grow with ``part``: one
campaign per part next to the seeded ones.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlane import schema as S
from ledgerlane.sources import seeds
from ledgerlane.sources.tables import Tables

SOURCE = {
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
              "props string",
}


def source(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE[name]).parquet(f"{root}/{name}.parquet")


def _project(df: DataFrame, schema: T.StructType, **columns: str) -> DataFrame:
    """The columns of a declared schema, each from its SQL expression."""
    return df.selectExpr(*(
        f"CAST({columns[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields
    ))


FIRST_PART_PROMOTION = len(S.SEED_PROMOTIONS) + 1


def books(spark: SparkSession, root: str) -> DataFrame:
    """Opening stock counts as taken in; the brand number names the supplier."""
    return _project(
        source(spark, root, "part"), S.BOOKS,
        BookID="p_partkey", Title="p_name", Author="p_brand", Genre="p_type",
        Price="p_retailprice", Stock="p_size", InputQuantity="p_size", OutputQuantity="0",
        SupplierID="substring(p_brand, 7)",
    )


def customers(spark: SparkSession, root: str) -> DataFrame:
    return _project(
        source(spark, root, "customer"), S.CUSTOMERS,
        CustomerID="c_custkey", Name="c_name",
        Email="concat(lower(replace(c_name, '#', '.')), '@', lower(c_mktsegment), '.example')",
        Phone="c_custkey + 10000000000",
    )


def suppliers(spark: SparkSession, root: str) -> DataFrame:
    return _project(
        source(spark, root, "supplier"), S.SUPPLIERS,
        SupplierID="s_suppkey", Name="s_name", Address="concat('Nation ', s_nationkey)",
        Phone="s_suppkey + 20000000000",
    )


_TOTAL = "CAST(o_totalprice AS DECIMAL(18,2))"
_PROMOTION = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 1 "
    f"WHEN '2-HIGH' THEN o_custkey + {FIRST_PART_PROMOTION} END"
)
_CUT = (
    "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') "
    f"THEN CAST({_TOTAL} * 0.05BD AS DECIMAL(18,2)) ELSE 0 END"
)


def orders(spark: SparkSession, root: str) -> DataFrame:
    """Urgent orders use the first seeded promotion, high ones that of a part."""
    return _project(
        source(spark, root, "orders"), S.ORDERS,
        OrderID="o_orderkey", CustomerID="o_custkey", OrderDate="o_orderdate",
        SubTotal=f"{_TOTAL} + {_CUT}", DiscountAmount=_CUT, TotalAmount="o_totalprice",
        PaymentMethodID="CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' "
                        "THEN substring(o_orderpriority, 1, 1) END",
        PromotionID=_PROMOTION,
        PaymentStatus="CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'pending' "
                      "ELSE 'failed' END",
        PaymentDate="CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END",
        TransactionID="CASE WHEN o_orderstatus = 'F' THEN concat('TXN_', o_orderkey) END",
    )


def order_details(spark: SparkSession, root: str) -> DataFrame:
    return _project(
        source(spark, root, "lineitem"), S.ORDER_DETAILS,
        OrderID="l_orderkey", BookID="l_partkey", Quantity="l_quantity", Price="l_extendedprice",
    )


_SHARE = "p_type IN ('ECONOMY', 'PROMO', 'SMALL')"
_STARTED = f"date_add(DATE '{S.SEED_PROMOTION_START}', p_size)"


def part_promotions(spark: SparkSession, root: str) -> DataFrame:
    return _project(
        source(spark, root, "part"), S.PROMOTIONS,
        PromotionID=f"p_partkey + {FIRST_PART_PROMOTION}",
        PromotionCode="concat('BOOK', p_partkey)",
        PromotionName="p_name", Description="p_type",
        DiscountType=f"if({_SHARE}, 'percentage', 'fixed_amount')",
        DiscountValue=f"if({_SHARE}, CAST(p_size AS DOUBLE), p_retailprice)",
        MinimumOrderAmount="p_size * 1000",
        MaximumDiscount="CASE WHEN p_size > 25 THEN p_retailprice END",
        StartDate=_STARTED, EndDate=f"date_add({_STARTED}, 140)",
        IsActive="p_brand <> 'Brand#13'",
        UsageLimit="CASE WHEN p_size <= 40 THEN p_size * 2 END",
        UsedCount="if(p_size = 40, 80, 1)",
        CreatedAt=_STARTED, UpdatedAt=_STARTED,
    )


def promotions(spark: SparkSession, root: str) -> DataFrame:
    return seeds.promotions(spark).unionByName(part_promotions(spark, root))


def promotion_targets(spark: SparkSession, root: str) -> DataFrame:
    """One or two targets per part campaign, depending on the part's type."""
    aims = source(spark, root, "part").selectExpr("p_partkey", """posexplode(CASE p_type
        WHEN 'ECONOMY' THEN array('product', 'all') WHEN 'LARGE' THEN array('all', 'product')
        WHEN 'STANDARD' THEN array('product') WHEN 'PROMO' THEN array('customer')
        WHEN 'SMALL' THEN array('category') ELSE array('all') END) AS (pos, aim)""")
    derived = _project(
        aims, S.PROMOTION_TARGETS,
        TargetID=f"(p_partkey + {FIRST_PART_PROMOTION}) * 2 + pos",
        PromotionID=f"p_partkey + {FIRST_PART_PROMOTION}",
        TargetType="aim",
        TargetID_Value="CASE WHEN aim IN ('product', 'customer') THEN p_partkey END",
    )
    return seeds.promotion_targets(spark).unionByName(derived)


def promotion_usage(spark: SparkSession, root: str) -> DataFrame:
    used = orders(spark, root).filter("PromotionID IS NOT NULL")
    return _project(
        used, S.PROMOTION_USAGE,
        UsageID="OrderID", PromotionID="PromotionID", OrderID="OrderID", CustomerID="CustomerID",
        DiscountAmount="DiscountAmount", UsedAt="OrderDate",
    )


def payment_methods_in_use(spark: SparkSession, root: str) -> DataFrame:
    """The methods that occur among the orders, named by their priority text."""
    found = source(spark, root, "orders").select("o_orderpriority").distinct()
    return _project(
        found, S.PAYMENT_METHODS,
        PaymentMethodID="substring(o_orderpriority, 1, 1)",
        MethodName="substring(o_orderpriority, 3)",
        Description="o_orderpriority",
        IsActive="o_orderpriority <> '4-NOT SPECIFIED'",
        CreatedAt=f"DATE '{S.SEED_PROMOTION_START}'",
    )


def star_tables(spark: SparkSession, root: str) -> Tables:
    derived = (
        books, customers, suppliers, orders, order_details, promotions, promotion_targets,
        promotion_usage,
    )
    loaders = {build.__name__: partial(build, spark, root) for build in derived}
    loaders["promotion_types"] = partial(seeds.promotion_types, spark)
    loaders["payment_methods"] = partial(seeds.payment_methods, spark)
    return Tables(loaders)
