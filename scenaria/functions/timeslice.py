"""Time-slice strings (``?ddd?hh``), hours of the year and calendar values.

Integer hours are the key everywhere; calendar values are made at the output.
Timestamps are zone-free so that results do not depend on the session zone.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenaria.functions.numeric import _c, to_number
from scenaria.functions.text import sub


def slice_hour(st: Column | str, offset: int = 0) -> Column:
    """1-based hour of the year. The offset is added without wrapping, so a
    +9 shift runs past 8760 into a 366th day."""
    day, hour = to_number(sub(st, 2, 4)), to_number(sub(st, 6, 7))
    return (day - 1) * 24 + hour + 1 + F.lit(offset)


def day_of_hour(hour: Column | str) -> Column:
    return (F.floor((_c(hour) - 1) / 24) + 1).cast("int")


def date_of_day(day: Column | str, year: int) -> Column:
    return F.date_add(F.lit(date(year, 1, 1)), _c(day).cast("int") - 1)


def timestamp_of_hour(hour: Column | str, year: int, shift: int = 0) -> Column:
    origin = F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("HOUR", _c(hour).cast("int") + F.lit(shift), origin)


def month_day(d: Column | str) -> Column:
    """Axis label such as ``Jul 25``."""
    return F.date_format(_c(d), "MMM dd")


def hour_window(start: str | date, end: str | date) -> tuple[int, int]:
    """First and last hour of the year of an inclusive date range."""
    a, b = (date.fromisoformat(d) if isinstance(d, str) else d for d in (start, end))
    jan1 = date(a.year, 1, 1)
    return (a - jan1).days * 24 + 1, (b - jan1).days * 24 + 24


def hour_window_columns(start: Column | str, end: Column | str) -> tuple[Column, Column]:
    """The same bounds for date columns."""
    jan1 = F.trunc(_c(start), "year")
    return F.datediff(_c(start), jan1) * 24 + 1, F.datediff(_c(end), jan1) * 24 + 24
