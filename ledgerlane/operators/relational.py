"""Relational building blocks used across the reports and jobs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_keys(names: Iterable[str]) -> list[Column]:
    """Sort columns from their names; a leading ``-`` sorts downwards."""
    return [F.desc(n[1:]) if n.startswith("-") else F.asc(n) for n in names]


def top_k(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first ``k`` rows; each task keeps only its own ``k`` candidates."""
    return df.orderBy(*sort_keys(order)).limit(k)


def listing(df: DataFrame, order: tuple[str, ...], ordered: bool) -> DataFrame:
    """A whole-table list.  The global sort costs one more shuffle, so it is asked for."""
    return df.orderBy(*sort_keys(order)) if ordered else df


def with_rank(df: DataFrame, *order: str) -> DataFrame:
    """Number the rows of an already limited list 1..k in its order."""
    return df.withColumn("Rank", F.row_number().over(Window.orderBy(*sort_keys(order))))


def latest_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the first in ``order``.

    Filtering ``row_number`` to 1 lets every map task drop all but one row per
    key before the shuffle, so a hot key costs no more than any other.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort_keys(order)))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def lookup(df: DataFrame, dim: DataFrame, key: str, absent: Column, *others: str) -> DataFrame:
    """Left join ``dim`` on ``key`` (and ``others``) where the key is often null.

    Rows without a key match nothing, yet a plain join would send all of them
    to one task.  They join on ``absent`` instead: a value of their own that no
    row of ``dim`` has.
    """
    keyed = df.withColumn("_key", F.coalesce(F.col(key), absent))
    return keyed.join(dim.withColumnRenamed(key, "_key"), ["_key", *others], "left").drop("_key")


def having_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the keys; each task sends a key once, however often it occurs."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def lacking_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def one_row(*frames: DataFrame) -> DataFrame:
    """Lay one-row frames side by side without a cross join."""
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame, allowMissingColumns=True)
    return united.agg(*(F.max(c).alias(c) for c in united.columns))
