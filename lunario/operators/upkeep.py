"""Table upkeep as pure functions: each returns the next state of a table, none writes in place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lunario.functions.text import NUMBER


def unique_rows(source: DataFrame, keys: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """``source`` unchanged; the query fails when a key occurs twice.

    A key holding NULL is a key like any other, but rows with a NULL in a ``required`` column are not
    compared; as many of them may share a key, each task's rows are a group of their own. The count
    runs in the partitioning and order that the join on the same keys needs, so it costs no shuffle
    of its own.
    """
    compared = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in required], F.lit(True))
    apart = {"_apart": F.when(~compared, F.spark_partition_id())} if required else {}
    one_key = Window.partitionBy(*keys, *apart)
    return (
        source.withColumns(apart)
        .withColumn("_rows", F.count(F.when(compared, F.lit(1))).over(one_key))
        .filter(F.assert_true(F.col("_rows") <= 1, F.lit("a key occurs twice in the source")).isNull())
        .drop("_rows", *apart)
    )


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target with the source merged in by key: matched rows take every source value.

    A NULL in a matched source row overwrites the target; rows only in the target stay. A key that
    the source holds twice is an error, so the target never grows by it. One full outer join reads
    each side once; to leave most of a large table alone, give it only the rows of the periods that
    change (``plans.reports.merge_periods``).
    """
    measures = [name for name in target.columns if name not in keys]
    incoming = unique_rows(source, keys).select(
        *keys, *[F.col(name).alias(f"_new_{name}") for name in measures], F.lit(True).alias("_hit")
    )
    return target.join(incoming, list(keys), "full_outer").select(
        *[
            name
            if name in keys
            else F.when(F.col("_hit"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)
            for name in target.columns
        ]
    )


def update_from(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    assignments: Mapping[str, Column],
    values: Sequence[str],
) -> DataFrame:
    """Set columns on target rows that have a source row; the others keep their values.

    ``assignments`` may use the target's columns and, prefixed ``new_``, the source's ``values``.
    A key that the source holds twice is an error.
    """
    incoming = unique_rows(source, keys).select(
        *keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("_hit")
    )
    joined = target.join(incoming, list(keys), "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), assignments[name]).otherwise(F.col(name)).alias(name)
            if name in assignments
            else name
            for name in target.columns
        ]
    )


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that a delete leaves: the condition is false or unknown."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def add_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add all-NULL columns of the given types."""
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items()})


def collapse_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with the greatest non-NULL value of every other column."""
    return df.groupBy(*keys).agg(
        *[F.max(name).alias(name) for name in df.columns if name not in keys]
    )


def key_violations(
    df: DataFrame, keys: Sequence[str], required: Sequence[str] | None = None
) -> DataFrame:
    """Keys that break the table's contract: repeated, or with a NULL in a required column."""
    must = list(keys if required is None else required)
    missing = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in must])
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("filas"),
            F.count_if(missing).alias("nulos"),
        )
        .filter((F.col("filas") > 1) | (F.col("nulos") > 0))
    )


def clean_simple(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Typed columns from all-text ones; text that does not fit is NULL.

    Only empty rows are dropped: those whose columns are all NULL or blank. A row whose text cannot
    be read stays, with NULLs. Numbers are plain digits with an optional sign, point and exponent;
    ``NaN``, ``Infinity``, ``5f`` and hexadecimal text are no numbers.
    """
    text = {name: F.trim(name) for name in types}
    present = reduce(lambda a, b: a | b, [F.coalesce(t != "", F.lit(False)) for t in text.values()])

    def typed(name: str, kind: str) -> Column:
        numeric = kind.split("(")[0] in ("double", "float", "decimal", "bigint", "int", "smallint")
        readable = F.when(text[name].rlike(NUMBER), text[name]) if numeric else text[name]
        return readable.try_cast(kind).alias(name)

    return df.filter(present).select(*[typed(name, kind) for name, kind in types.items()])
