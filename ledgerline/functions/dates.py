"""Calendar helpers."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(d) -> _dt.date:
    """Accept a date, a datetime or a ``YYYY-MM-DD`` string (bad input raises)."""
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    return _dt.datetime.strptime(str(d), "%Y-%m-%d").date()


def to_day(c) -> Column:
    """timestamp -> date."""
    return F.to_date(_col(c))


def parse_day(c) -> Column:
    """``YYYY-MM-DD`` text -> date; malformed text raises under ANSI."""
    return F.to_date(_col(c), "yyyy-MM-dd")


def month_start(c) -> Column:
    """First day of the month of a date/timestamp column."""
    return F.trunc(_col(c), "month")


def datediff_days(end, start) -> Column:
    """Whole days ``end - start`` as INT, may be negative."""
    return F.datediff(_col(end), _col(start))


def now() -> Column:
    """Audit time, constant within one query."""
    return F.current_timestamp()
