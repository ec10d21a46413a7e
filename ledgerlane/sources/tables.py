"""The bundle of logical tables that every report and job takes as input."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ledgerlane.schema import SCHEMAS


class Tables:
    """Named DataFrames, built when first asked for.

    ``tables.orders`` gives the frame; a report touches only what it reads.
    """

    def __init__(self, loaders: Mapping[str, Callable[[], DataFrame] | DataFrame]):
        unknown = set(loaders) - set(SCHEMAS)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._loaders = dict(loaders)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._loaders:
            raise AttributeError(name)
        found = self._loaders[name]
        frame = found() if callable(found) else found
        self.__dict__[name] = frame
        return frame

    def replace(self, **frames: DataFrame) -> Tables:
        """A copy with some tables exchanged, e.g. the state after a job."""
        return Tables({**self._loaders, **frames})


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> Tables:
    """Tables stored one folder each under ``root`` in the declared schemas."""

    def loader(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.schema(SCHEMAS[name]).format(fmt).load(f"{root}/{name}")

    return Tables({name: loader(name) for name in SCHEMAS})


def empty_tables(spark: SparkSession) -> Tables:
    """All tables with no rows: a shop before its first day."""
    return Tables({
        name: (lambda s=schema: spark.createDataFrame([], s)) for name, schema in SCHEMAS.items()
    })
