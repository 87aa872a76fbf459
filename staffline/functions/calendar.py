"""Date and time expressions, all on zone-less timestamps."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, functions as F

# The range a nanosecond timestamp can hold. Dates outside it
# (9999-12-31 is a common "no end" marker) read as null.
EARLIEST = "1677-09-21 00:12:43.145225"
LATEST = "2262-04-11 23:47:16.854775"

# Fixed pattern: a DB2 stamp, YYYY-MM-DD-HH.MM.SS.ffffff.
DB2_STAMP = r"^(\d{4}-\d{2}-\d{2})-(\d{2})\.(\d{2})\.(\d{2})\.(\d+)$"

DAYS_PER_YEAR = 365.25


def ntz(moment: str | date | datetime | Column) -> Column:
    if not isinstance(moment, Column):
        moment = F.lit(str(moment))
    return moment.cast("timestamp_ntz")


def read_moment(value: Column) -> Column:
    """A plain ISO date or a DB2 stamp as a timestamp; anything else is null. Only
    texts with a dash after the date can be DB2 stamps."""
    text = value.cast("string")
    plain = F.regexp_replace(text, DB2_STAMP, "$1 $2:$3:$4.$5")
    maybe_stamp = F.substring(text, 11, 1) == "-"
    return F.when(maybe_stamp, plain).otherwise(text).try_cast("timestamp_ntz")


def within_range(moment: Column) -> Column:
    return F.when(moment.between(ntz(EARLIEST), ntz(LATEST)), moment)


def parse_timestamp(value: Column) -> Column:
    """Plain ISO dates and DB2 stamps; anything else, or out of range, is null."""
    return within_range(read_moment(value))


def _time_of_day(moment: Column) -> Column:
    return moment - moment.cast("date").cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down, time of day respected."""
    return F.date_diff(end, start) - F.when(_time_of_day(end) < _time_of_day(start), 1).otherwise(0)


def elapsed_years(start: Column, end: Column) -> Column:
    return days_between(start, end) / F.lit(DAYS_PER_YEAR)


def age_in_years(birth: Column, as_of: str | date | Column) -> Column:
    return F.floor(elapsed_years(birth, ntz(as_of)))


def effective_end(dismissed: Column | None, planned: Column | None) -> Column:
    """Dismissal when known, else the planned end, else null (still open)."""
    known = [c for c in (dismissed, planned) if c is not None]
    return F.coalesce(*known) if known else F.lit(None).cast("timestamp_ntz")


def month_cut_continues(end: Column, start: Column) -> Column:
    """Whether a gap is only administrative: the next contract starts exactly one
    day later, or one ends in the last three days of a month and the next starts
    on the first day of the month after it."""
    next_day = end + F.expr("INTERVAL 1 DAY") == start
    last_days = F.dayofmonth(end) >= F.dayofmonth(F.last_day(end)) - 2
    next_first = F.add_months(F.trunc(end, "MM"), 1) == start.cast("date")
    return next_day | (last_days & next_first)
