"""Last known figures kept up to date as their table changes.

For each period the state holds, per series, the greatest value of the period: what the measure needs of
it. States of different periods merge by taking the newest, so after a change only the states of the
periods concerned are made anew, from these periods alone; the figures come from the states.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lunario.plans.stored import exchange_periods, in_periods, store


def period_state(
    table: DataFrame, value: str, keys: Sequence[str] = (), period: str = "fecha"
) -> DataFrame:
    """One row per series and period that has a value."""
    known = table.filter(F.col(value).isNotNull() & F.col(period).isNotNull())
    return known.groupBy(*keys, period).agg(F.max(value).alias("valor"))


def keep_state(
    spark: SparkSession, table_path: str, state_path: str, value: str, keys: Sequence[str] = (),
    period: str = "fecha",
) -> None:
    """Make the state of a stored table for the first time."""
    store(period_state(spark.read.parquet(table_path), value, keys, period), state_path, period)


def renew_state(
    spark: SparkSession, table_path: str, state_path: str, touched: Collection, staged_path: str,
    value: str, keys: Sequence[str] = (), period: str = "fecha",
) -> None:
    """Renew the state of the touched periods; those that hold no value any more are removed."""
    rows = in_periods(spark.read.parquet(table_path), touched, period)
    state = period_state(rows, value, keys, period)
    exchange_periods(spark, state, state_path, touched, staged_path, period)


def last_known(
    spark: SparkSession, state_path: str, keys: Sequence[str] = (), period: str = "fecha"
) -> DataFrame:
    """Per series the newest period with a value, and the value: ``last_non_blank`` of the table."""
    state = spark.read.parquet(state_path)
    newest = state.groupBy(*keys).agg(
        F.max(period).alias("fecha"), F.max_by("valor", period).alias("valor")
    )
    return newest.filter(F.col("fecha").isNotNull())
