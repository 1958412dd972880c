"""Pivots, un-pivots and joins that give tables their final shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_pivot(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    cells: Mapping[str, Column],
    how: str = "max",
) -> DataFrame:
    """One column per ``{name: condition}``, aggregated over the rows where it holds.

    The column list is fixed, so there is no pass over the data to find it; the aggregate is
    combined map side and shuffles one row per key and task.
    """
    combine = {"max": F.max, "sum": F.sum}[how]
    return df.groupBy(*keys).agg(
        *[combine(F.when(condition, F.col(value))).alias(name) for name, condition in cells.items()]
    )


def unpivot_cells(
    df: DataFrame,
    ids: Sequence[str],
    attributes: Mapping[str, Sequence[str]],
    names: Sequence[str],
    value: str,
) -> DataFrame:
    """One row per id and cell; the cell's column name becomes its attribute values."""
    long = df.unpivot(list(ids), list(attributes), "_cell", value)

    def attribute(position: int, name: str) -> str:
        cases = " ".join(f"WHEN '{cell}' THEN '{a[position]}'" for cell, a in attributes.items())
        return f"CASE _cell {cases} END AS `{name}`"

    return long.selectExpr(*ids, *[attribute(i, name) for i, name in enumerate(names)], value)


def spine_join(
    spine: DataFrame, others: Sequence[tuple[DataFrame, Sequence[str]]], on: Sequence[str]
) -> DataFrame:
    """Left-join the named columns of each table to the spine; no spine row is lost."""
    return reduce(
        lambda left, right: left.join(right[0].select(*on, *right[1]), list(on), "left"),
        others,
        spine,
    )


def attach_constant(
    df: DataFrame,
    source: DataFrame,
    constants: Mapping[str, Column],
    keys: Sequence[str] = (),
    required: bool = True,
) -> DataFrame:
    """Add aggregates of ``source`` (one row for each key) to every row of ``df``.

    Without keys they are one scalar subquery, evaluated once; with keys a join on them, so
    nothing is multiplied (NULL is a key of its own). ``required`` drops rows whose constants do not exist.
    """
    single = source.groupBy(*keys).agg(*[c.alias(name) for name, c in constants.items()])
    if keys:
        held = single.select(
            *[F.col(key).alias(f"_key_{key}") for key in keys], *constants
        )
        same = reduce(
            lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_key_{key}")) for key in keys]
        )
        attached = df.join(held, same, "left").select(*df.columns, *constants)
    else:
        packed = single.select(F.struct(*constants).alias("_constants"))
        attached = (
            df.withColumn("_constants", packed.scalar())
            .select(*df.columns, *[F.col(f"_constants.{n}").alias(n) for n in constants])
        )
    if not required:
        return attached
    return attached.filter(
        reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in constants])
    )
