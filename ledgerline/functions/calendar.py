"""Calendar expressions with the semantics the jobs are specified in.

* weekday numbers count from Sunday = 0 (Spark's ``dayofweek`` starts at Sunday = 1);
* weekday and month names are the full English names ('Friday', 'November');
* month and day differences count calendar boundaries crossed (31 Jan -> 1 Feb is one month,
  23:00 -> 01:00 the next day is one day), not whole elapsed periods.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday labels, Sunday first, as used by the order heatmap.
WEEKDAY_ABBREV = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of(ts: Column | str) -> Column:
    return F.to_date(_col(ts))


def midnight(day: Column | str) -> Column:
    """A DATE as TIMESTAMP_NTZ at 00:00 (the output type of day columns)."""
    return _col(day).cast("timestamp_ntz")


def month_start(ts: Column | str) -> Column:
    """Midnight of the first day of the month, TIMESTAMP_NTZ (what a month truncation of a
    timestamp yields). Built from the date, so no session time zone is involved."""
    return F.trunc(F.to_date(_col(ts)), "month").cast("timestamp_ntz")


def weekday_number(ts: Column | str) -> Column:
    """0 = Sunday .. 6 = Saturday, BIGINT."""
    return (F.dayofweek(_col(ts)) - 1).cast("bigint")


def weekday_name(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "EEEE")


def month_name(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "MMMM")


def hour_of(ts: Column | str) -> Column:
    return F.hour(_col(ts)).cast("bigint")


def months_between_starts(start: Column | str, end: Column | str) -> Column:
    """Month boundaries crossed from ``start`` to ``end`` (BIGINT)."""
    s, e = _col(start), _col(end)
    return ((F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))).cast("bigint")


def days_between(start: Column | str, end: Column | str) -> Column:
    """Day boundaries crossed from ``start`` to ``end`` (BIGINT)."""
    return F.datediff(F.to_date(_col(end)), F.to_date(_col(start))).cast("bigint")


def weekday_abbrev(dow: Column | str) -> Column:
    """Sun..Sat label for a Sunday = 0 weekday number."""
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAY_ABBREV]), _col(dow).cast("int") + 1)
