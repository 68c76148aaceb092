"""Calendar fields as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# First year of the trend counters unless a caller passes another.
BASE_YEAR = 1979


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_parts(date: str | Column) -> dict[str, Column]:
    """Year, month, day and day of year, each as INT."""
    d = _col(date)
    return {
        "year": F.year(d).cast("int"),
        "month": F.month(d).cast("int"),
        "day": F.dayofmonth(d).cast("int"),
        "day_of_year": F.dayofyear(d).cast("int"),
    }


def month_name(date: str | Column) -> Column:
    return F.date_format(_col(date), "MMMM")


def quarter_of(month: str | Column) -> Column:
    return (F.floor((_col(month) - 1) / 3) + 1).cast("int")


def month_start(year: str | Column, month: str | Column) -> Column:
    return F.make_date(_col(year), _col(month), F.lit(1))


def month_index(year: str | Column, month: str | Column) -> Column:
    """Months since year 0: consecutive calendar months differ by exactly one."""
    return (_col(year) * 12 + _col(month) - 1).cast("int")


def cyclic(position: str | Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle.

    The period for day-of-year is 365 in leap years too, so that 31 December of a
    leap year passes a full turn.
    """
    angle = _col(position) * F.lit(2.0 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def day_trend(year: str | Column, day_of_year: str | Column, base_year: int = BASE_YEAR) -> Column:
    return ((_col(year) - base_year) * 365 + _col(day_of_year)).cast("int")


def month_trend(year: str | Column, month: str | Column, base_year: int = BASE_YEAR) -> Column:
    return F.greatest(F.lit(0), (_col(year) - base_year) * 12 + _col(month) - 1).cast("int")
