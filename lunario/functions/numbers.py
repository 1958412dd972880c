"""Guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NULL, not an error, for a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0))


def percent_change(current: Column, previous: Column) -> Column:
    """Relative change in percent, as DOUBLE; NULL when there is no usable previous value."""
    now, before = current.cast("double"), previous.cast("double")
    return ratio(now - before, before) * 100
