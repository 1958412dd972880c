"""Order-dependent operators over the lines of a file, without one task per file.

A running count or a fill-down needs every earlier line. Both are done in two passes over *blocks*
(an input split, or a fixed range of line numbers): the first reduces each block to one row, map
side; a window over those rows gives what each block inherits; the second works inside blocks only.
No task ever holds more than one block of lines, however long the file is. The join is a left one
although every line has its block: only the one-row-per-block side can then be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_LINES = 100_000


def line_block(line: str, lines: int = BLOCK_LINES) -> Column:
    """Block number of a line id; lines without an id share the first block.

    Being never NULL, it adds no filter to one side of the join on it, so both passes can read the
    same exchange.
    """
    return F.coalesce(F.floor(F.col(line) / lines), F.lit(0))


def _ids(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """Columns that tell apart the same rows as ``names`` but hold no NULL, so that joins on them
    lose none and every branch shuffles by the same expressions."""
    ids: dict[str, Column] = {}
    for n, name in enumerate(names):
        kind = df.schema[name].dataType
        plain = "" if isinstance(kind, T.StringType) else "0"
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            plain = "1970-01-01"
        ids[f"_id{n}"] = F.coalesce(F.col(name), F.lit(plain).cast(kind))
        ids[f"_no{n}"] = F.col(name).isNull()
    return ids


def _cut(
    df: DataFrame, within: Sequence[str], line: str, block: str | None
) -> tuple[DataFrame, list[str], list[str]]:
    """Lines with the ids of their file, and of their block in it."""
    ids = _ids(df, within)
    lines = df.withColumns({**ids, "_block": F.coalesce(block, F.lit(-1)) if block else line_block(line)})
    return lines, list(ids), [*ids, "_block"]


def fill_down(
    df: DataFrame,
    column: str,
    into: str,
    line: str,
    within: Sequence[str] = (),
    block: str | None = None,
) -> DataFrame:
    """Add ``into``: the last non-NULL ``column`` at or above each line of its file.

    ``within`` names the file (NULL is a file of its own), ``line`` orders its lines; ``block`` is
    the column naming the input split, or None to cut by line number. A numeric ``column`` keeps the
    first pass a hash aggregate; text would make it sort every line. Lines without an id are one
    block of their file, read by one task.
    """
    lines, file, part = _cut(df, within, line, block)
    seen = F.when(F.col(column).isNotNull(), F.col(line))
    earlier = Window.partitionBy(*file).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        lines.groupBy(*part)
        .agg(F.max_by(column, seen).alias("_tail"))
        .select(*part, F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    )
    above = Window.partitionBy(*part).orderBy(line)
    return (
        lines.join(carried, part, "left")
        .withColumn(
            into, F.coalesce(F.last(column, ignorenulls=True).over(above), F.col("_carry"))
        )
        .drop(*part, "_carry")
    )


def running_count(
    df: DataFrame,
    column: str,
    into: str,
    line: str,
    within: Sequence[str] = (),
    block: str | None = None,
) -> DataFrame:
    """Add ``into``: how many non-NULL ``column`` values stand at or above each line.

    ``within``, ``line`` and ``block`` are those of ``fill_down``.
    """
    lines, file, part = _cut(df, within, line, block)
    earlier = Window.partitionBy(*file).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        lines.groupBy(*part)
        .agg(F.count(column).alias("_inside"))
        .select(*part, F.coalesce(F.sum("_inside").over(earlier), F.lit(0)).alias("_carry"))
    )
    above = Window.partitionBy(*part).orderBy(line)
    return (
        lines.join(carried, part, "left")
        .withColumn(into, F.col("_carry") + F.count(column).over(above))
        .drop(*part, "_carry")
    )


def fill_within_group(
    df: DataFrame, column: str, into: str, group: Sequence[str], spread: int = 16
) -> DataFrame:
    """Add ``into``: the greatest ``column`` of each group, on every row of the group.

    NULL is a group of its own. The maximum is taken by a map-side aggregate and joined back. Rows
    are dealt to ``spread`` sub-keys by their content, and each group's maximum to all of them, so a
    group holding a large share of the rows is joined by as many tasks.
    """
    ids = _ids(df, group)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
    rows = df.withColumns({**ids, "_salt": salt.cast("int")})
    top = (
        df.withColumns(ids)
        .groupBy(*ids)
        .agg(F.max(column).alias(into))
        .withColumn("_salt", F.explode(F.array(*[F.lit(n) for n in range(spread)])))
    )
    return rows.join(top, [*ids, "_salt"], "left").drop(*ids, "_salt")
