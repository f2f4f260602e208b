"""Calendar column expressions (F1, F2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c: str | Column) -> Column:
    """First day of the value's month, as a DATE (F1).

    ``trunc`` works on dates, so the result does not move with the session
    time zone the way ``date_trunc`` on a zoned timestamp would.
    """
    return F.trunc(F.to_date(_col(c)), "month")


def days_between(end: str | Column, start: str | Column) -> Column:
    """Whole calendar days from ``start`` to ``end`` (F2); negative when
    ``end`` comes first. Time of day is ignored."""
    return F.datediff(F.to_date(_col(end)), F.to_date(_col(start)))
