"""Month calendars.

A calendar is generated from its two end points, so its size is the number of months spanned and
never depends on how many rows a series has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def month_calendar(df: DataFrame, date: str = "fecha", keys: Sequence[str] = ()) -> DataFrame:
    """First day of every month from the first to the last date of ``df``, for each key.

    Dates may lie anywhere in their months; a NULL key is a key of its own.
    """
    month = F.trunc(date, "month")
    ends = df.groupBy(*keys).agg(F.min(month).alias("_first"), F.max(month).alias("_last"))
    return ends.filter(F.col("_first").isNotNull()).select(
        *keys, F.explode(F.sequence("_first", "_last", F.expr("interval 1 month"))).alias(date)
    )


def calendar_dimension(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Continuous month dimension between two fixed dates, with its usual attributes."""
    ends = (F.lit(first).cast("date"), F.lit(last).cast("date"))
    months = spark.range(1).select(
        F.explode(F.sequence(*ends, F.expr("interval 1 month"))).alias("fecha")
    )
    return months.select(
        "fecha",
        F.year("fecha").alias("anio"),
        F.month("fecha").alias("mes"),
        F.quarter("fecha").alias("trimestre"),
    )


def densify(df: DataFrame, date: str = "fecha", keys: Sequence[str] = ()) -> DataFrame:
    """One row per calendar month of each key; measures are NULL where ``df`` has no row.

    ``date`` becomes the first day of the month; rows without a date belong to no month.
    """
    ids = [*keys, date]
    months = month_calendar(df, date, keys).select(*[F.col(c).alias(f"_c_{c}") for c in ids])
    dated = df.withColumn(date, F.trunc(date, "month"))
    same = F.col(f"_c_{date}") == F.col(date)
    for key in keys:
        same = same & F.col(f"_c_{key}").eqNullSafe(F.col(key))
    return months.join(dated, same, "left").select(
        *[F.col(f"_c_{c}").alias(c) for c in ids],
        *[c for c in df.columns if c not in ids],
    )
