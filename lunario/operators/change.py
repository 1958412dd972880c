"""Previous values and percent changes.

Three ways to find the earlier row of a series:

* ``row``: the n-th row before in date order.
* ``calendar``: the row dated exactly n months before, gap-safe, as a one-row RANGE frame. The
  input is read once and, like ``row``, shuffled once by the series keys.
* ``join``: the same row as ``calendar`` through an equi-join on (keys, date). It shuffles twice
  but its key is unique per row, so the length of a series does not matter.

A series holds one row per period (``key_violations`` checks it), so a window partition is bounded
by the calendar. Without keys the input is a single series, for the same reason never longer than
the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lunario.functions.numbers import percent_change


def previous_value(
    df: DataFrame,
    columns: Mapping[str, str],
    lag: int = 12,
    mode: str = "row",
    date: str = "fecha",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add, per ``{column: new name}``, the value ``lag`` periods earlier."""
    if mode == "row":
        series = Window.partitionBy(*keys).orderBy(date)
        return df.withColumns({new: F.lag(old, lag).over(series) for old, new in columns.items()})
    if mode == "calendar":
        part = f"PARTITION BY {', '.join(f'`{key}`' for key in keys)} " if keys else ""
        back = f"INTERVAL '{lag}' MONTH PRECEDING"
        frame = f"{part}ORDER BY `{date}` RANGE BETWEEN {back} AND {back}"
        return df.withColumns(
            {new: F.expr(f"max(`{old}`) OVER ({frame})") for old, new in columns.items()}
        )
    if mode != "join":
        raise ValueError(f"unknown mode {mode!r}: use 'row', 'calendar' or 'join'")
    earlier = df.select(
        *keys,
        F.col(date).alias("_reference"),
        *[F.col(old).alias(new) for old, new in columns.items()],
    )
    dated = df.withColumn("_reference", F.add_months(date, -lag))
    return dated.join(earlier, [*keys, "_reference"], "left").select(
        *df.columns, *columns.values()
    )


def period_change(
    df: DataFrame,
    columns: Mapping[str, str],
    lag: int = 12,
    mode: str = "row",
    date: str = "fecha",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add, per ``{column: new name}``, the percent change against ``lag`` periods earlier."""
    held = {old: f"_previous_{old}" for old in columns}
    return (
        previous_value(df, held, lag, mode, date, keys)
        .withColumns(
            {new: percent_change(F.col(old), F.col(held[old])) for old, new in columns.items()}
        )
        .drop(*held.values())
    )
