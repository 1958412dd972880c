"""Profiles, counts, top rows and last-known values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, value: str, date: str = "fecha", keys: Sequence[str] = ()) -> DataFrame:
    """Rows, first and last date, NULLs and zeros of a series."""
    column = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_filas"),
        F.min(date).alias("fecha_inicio"),
        F.max(date).alias("fecha_fin"),
        (F.count(F.lit(1)) - F.count(column)).alias("nulls_detectados"),
        F.sum(F.when(column == 0, 1).otherwise(0)).alias("ceros_detectados"),
    )


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cantidad_registros"))


def latest(df: DataFrame, rows: int, date: str = "fecha", ties: Sequence[str] = ()) -> DataFrame:
    """The ``rows`` newest rows; ``ties`` orders rows of one date. A per-task heap, no full sort."""
    return df.orderBy(F.col(date).desc(), *ties).limit(rows)


def last_non_blank(
    df: DataFrame, value: str, date: str = "fecha", keys: Sequence[str] = ()
) -> DataFrame:
    """Newest date that has a value, and the greatest value on that date, for each key.

    With the date among the keys the same measure is a time series instead of a single figure.
    Rows of one date are combined first; both steps are hash aggregates that combine map side, so
    a key with most of the rows is spread over its dates.
    """
    series = [key for key in keys if key != date]
    daily = df.filter(F.col(value).isNotNull()).groupBy(*series, date).agg(
        F.max(value).alias("valor")
    )
    if date in keys:
        return daily.withColumnRenamed(date, "fecha")
    newest = daily.groupBy(*series).agg(
        F.max(date).alias("fecha"), F.max_by("valor", date).alias("valor")
    )
    return newest.filter(F.col("fecha").isNotNull())
