"""Frames of the rows a new shop starts with.

They are small by definition and become local relations, whose size the
planner knows when it chooses how to join them.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlane import schema as S

SEEDED_AT = dt.datetime.fromisoformat(S.SEED_PROMOTION_START).replace(tzinfo=dt.timezone.utc)


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    named = [dict(zip(schema.fieldNames(), row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, to_arrow_schema(schema)), schema)


def promotion_types(spark: SparkSession) -> DataFrame:
    return local_frame(spark, list(S.SEED_PROMOTION_TYPES), S.PROMOTION_TYPES)


def payment_methods(spark: SparkSession) -> DataFrame:
    rows = [(*method, True, SEEDED_AT) for method in S.SEED_PAYMENT_METHODS]
    return local_frame(spark, rows, S.PAYMENT_METHODS)


def promotions(spark: SparkSession) -> DataFrame:
    start, end = map(dt.date.fromisoformat, (S.SEED_PROMOTION_START, S.SEED_PROMOTION_END))
    rows = [
        (key, code, name, text, kind, Decimal(value), Decimal(minimum), None, start, end, True,
         limit, 0, SEEDED_AT, SEEDED_AT)
        for key, code, name, text, kind, value, minimum, limit in S.SEED_PROMOTIONS
    ]
    return local_frame(spark, rows, S.PROMOTIONS)


def promotion_targets(spark: SparkSession) -> DataFrame:
    rows = [(*target, None) for target in S.SEED_PROMOTION_TARGETS]
    return local_frame(spark, rows, S.PROMOTION_TARGETS)
