"""Month keys and date text."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid import fixed_values as fv


def month_key(moment: Column) -> Column:
    return F.date_format(moment, "yyyy_MM")


def month_start(month: Column) -> Column:
    return F.to_date(month, "yyyy_MM")


def month_between(month: Column, start, end) -> Column:
    """First day of the month inside [start, end], both ends included.

    Month keys sort like their months, so the bounds become keys and the comparison is
    one of plain text, which a scan can use.
    """
    first, last = (
        x if isinstance(x, datetime.date) else datetime.date.fromisoformat(str(x)[:10])
        for x in (start, end)
    )
    if first.day > 1:
        first = (first.replace(day=1) + datetime.timedelta(days=32)).replace(day=1)
    return month.between(f"{first.year:04}_{first.month:02}", f"{last.year:04}_{last.month:02}")


def parse_moment(text: Column) -> Column:
    """Timestamp text -> timestamp; the empty-date text and bad text -> null."""
    return F.try_to_timestamp(F.nullif(text, F.lit(fv.EMPTY_DATE_TEXT)))


def year_month_of(text: Column) -> tuple[Column, Column]:
    """(year, month) of date text, nulls for invalid text."""
    day = text.try_cast("date")
    return F.year(day), F.month(day)
