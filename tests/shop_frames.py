"""Small frames for the shop's tests.  A module of its own: any folder of tests may have a conftest."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlane.sources import seeds


def _value(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value)).quantize(Decimal("0.01"))
    if isinstance(kind, T.DateType) and isinstance(value, str):
        return dt.date.fromisoformat(value)
    if isinstance(kind, T.TimestampType):
        moment = dt.datetime.fromisoformat(value) if isinstance(value, str) else value
        return moment.replace(tzinfo=dt.timezone.utc)
    return value


def frame(spark: SparkSession, schema: T.StructType, *rows: dict) -> DataFrame:
    """Rows given by column name; what is left out is null."""
    filled = [tuple(_value(r.get(f.name), f.dataType) for f in schema.fields) for r in rows]
    return seeds.local_frame(spark, filled, schema)


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    """Collected rows of the columns, decimals as floats."""
    picked = df.select(*columns) if columns else df
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    return [tuple(plain(v) for v in r) for r in picked.collect()]


def one(df: DataFrame) -> dict:
    found = df.collect()
    assert len(found) == 1
    return {k: float(v) if isinstance(v, Decimal) else v for k, v in found[0].asDict().items()}
