"""The one place where clocks, weekdays, slots and sessions are derived.

Times are UTC; the trading clock is New York. Weekdays count from Monday = 0. A session rolls at 17:00 New York.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


def new_york(ts: Column) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), ZONE)


def slot(local: Column) -> Column:
    """Half-hour slot as HH:MM."""
    return F.format_string("%02d:%02d", F.hour(local), (F.floor(F.minute(local) / 30) * 30).cast("int"))


def weekday(local: Column) -> Column:
    return F.weekday(local).cast("int")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def session_date(local: Column) -> Column:
    """The date of the session: from 17:00 on, the next day's."""
    return F.to_date(local + F.expr("INTERVAL 7 HOURS"))


def crosses_close(entry_local: Column, exit_local: Column) -> Column:
    """Whether a 17:00 lies within (entry, exit]."""
    return session_date(entry_local) < session_date(exit_local)


def in_window(minute_of_day: Column, start: int, end: int) -> Column:
    """Membership in [start, end) minutes of a day, wrapping midnight if start > end."""
    return (minute_of_day >= start) & (minute_of_day < end) if start <= end else (minute_of_day >= start) | (minute_of_day < end)
