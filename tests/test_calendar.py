import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlane.functions import calendar as C

NOON = dt.datetime(2024, 3, 31, 12)


@pytest.mark.parametrize("as_of, span, first", [
    (NOON, {"days": 30}, dt.date(2024, 3, 2)),  # the boundary day is out at noon
    (dt.datetime(2024, 3, 31), {"days": 30}, dt.date(2024, 3, 1)),  # and in at midnight
    (dt.datetime(2024, 3, 31), {"months": 1}, dt.date(2024, 2, 29)),
    (dt.datetime(2023, 3, 31), {"months": 1}, dt.date(2023, 2, 28)),
    (dt.datetime(2024, 2, 29), {"months": 12}, dt.date(2023, 2, 28)),
    (dt.datetime(2024, 1, 15, 0, 0, 1), {"months": 12}, dt.date(2023, 1, 16)),
    (dt.datetime(2024, 12, 5), {"months": 12}, dt.date(2023, 12, 5)),
    (NOON, {"weeks": 4}, dt.date(2024, 3, 4)),
])
def test_first_day_since(as_of, span, first):
    assert C.first_day_since(as_of, **span) == first


def test_iso_weeks_cross_the_year(spark):
    days = [("2020-12-27",), ("2020-12-28",), ("2021-01-03",), ("2021-01-04",), ("2018-12-31",)]
    df = spark.createDataFrame(days, "d string").select(F.to_date("d").alias("d"))
    weeks = [r[0] for r in df.orderBy("d").select(C.iso_yearweek("d")).collect()]
    assert weeks == [201901, 202052, 202053, 202053, 202101]
