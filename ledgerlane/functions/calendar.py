"""Time rules: every "now" is an explicit ``as_of``."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH = "yyyy-MM"
DAY = "yyyy-MM-dd"


def _months_back(moment: dt.datetime, months: int) -> dt.datetime:
    year, month = divmod(moment.year * 12 + moment.month - 1 - months, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return moment.replace(year=year, month=month + 1, day=min(moment.day, last))


def first_day_since(as_of: dt.datetime, *, days: int = 0, weeks: int = 0, months: int = 0) -> dt.date:
    """The first date whose midnight is not before ``as_of`` minus the interval.

    A date column is compared as midnight, so unless ``as_of`` is midnight
    itself the boundary day is out.  Months clamp at the month's end.
    """
    start = _months_back(as_of, months) - dt.timedelta(days=days, weeks=weeks)
    day = start.date()
    return day if start.time() == dt.time() else day + dt.timedelta(days=1)


def since(day: Column | str, as_of: dt.datetime, **interval: int) -> Column:
    """Bare column against a literal date, so the scan can use it; no upper bound."""
    column = F.col(day) if isinstance(day, str) else day
    return column >= F.lit(first_day_since(as_of, **interval))


def iso_yearweek(day: Column | str) -> Column:
    """ISO year and Monday week as one number, e.g. 202053 for 2021-01-03."""
    return F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)
