from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from ledgerlane import schema as S  # noqa: E402
from ledgerlane.session import configure  # noqa: E402
from ledgerlane.sources.tables import Tables, empty_tables  # noqa: E402
from shop_frames import frame  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    warehouse = tmp_path_factory.mktemp("warehouse")
    builder = (
        SparkSession.builder.master("local[8]").appName("ledgerlane-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(warehouse))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    )
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def shop(spark):
    """Build tables from rows per table name; tables not named are empty."""
    def build(**tables: list[dict]) -> Tables:
        return empty_tables(spark).replace(
            **{name: frame(spark, S.SCHEMAS[name], *rows) for name, rows in tables.items()}
        )
    return build
