"""Calendar arithmetic on DATE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lunario.functions.text import MONTHS


def month_start(moment: Column) -> Column:
    """First day of the month of a date or timestamp."""
    return F.trunc(moment.cast("date"), "month")


def shift_months(date: Column, months: int) -> Column:
    """Same day ``months`` later, clipped to the month's end (29 Feb less a year is 28 Feb)."""
    return F.add_months(date, months)


def month_name(date: Column) -> Column:
    """Spanish month name of a date, in lower case as the Spanish locale prints it."""
    names = F.array(*[F.lit(name) for name in MONTHS])
    return F.get(names, F.month(date) - 1)
