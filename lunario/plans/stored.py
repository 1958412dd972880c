"""Deletes, updates and publication of stored tables.

A table partitioned by period is changed in place, touching only the periods concerned: their new rows
are staged first, so a failure before the exchange leaves the table as it was, and a failure after it
is mended by running the job again. Lists of periods come to the driver; they are as short as the
calendar. A table can also be a folder of versions, of which only complete and checked ones are current.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lunario.operators.upkeep import delete_where, unique_rows, update_from
from lunario.sources.shared import mark, names_in, remove
from lunario.sources.tables import replace_periods, snapshot


def periods_of(df: DataFrame, period: str = "fecha") -> list:
    """The distinct periods of a table, NULL among them if it occurs."""
    return [row[0] for row in df.select(period).distinct().collect()]


def in_periods(df: DataFrame, periods: Collection, period: str = "fecha") -> DataFrame:
    """Rows of the given periods; on a partitioned table the others are not read."""
    known = [p for p in periods if p is not None]
    wanted = F.col(period).isin(known) if known else F.lit(False)
    return df.filter(wanted | F.col(period).isNull() if None in periods else wanted)


def store(df: DataFrame, path: str, period: str = "fecha") -> None:
    """Write a new table partitioned by period; a period with most of the rows is many files."""
    snapshot(df.hint("rebalance", period), path, [period])


def remove_periods(spark: SparkSession, path: str, periods: Collection, period: str = "fecha") -> None:
    """Delete the partitions of the given periods."""
    gone = {"__HIVE_DEFAULT_PARTITION__" if p is None else str(p) for p in periods}
    for name in names_in(spark, path):
        if name.partition("=")[0] == period and name.partition("=")[2] in gone:
            remove(spark, f"{path}/{name}")


def exchange_periods(
    spark: SparkSession, rows: DataFrame, path: str, touched: Collection, staged_path: str,
    period: str = "fecha",
) -> None:
    """Make ``rows`` all that the touched periods of a stored table hold.

    ``rows`` may read the table. Periods without rows lose their partition: a dynamic overwrite
    alone would leave the old one.
    """
    snapshot(rows, staged_path)
    staged = spark.read.schema(rows.schema).parquet(staged_path)
    replace_periods(staged.hint("rebalance", period), path, period)
    left = set(periods_of(staged, period))
    remove_periods(spark, path, [p for p in touched if p not in left], period)


def delete_stored(
    spark: SparkSession, path: str, condition: Column, staged_path: str, period: str = "fecha"
) -> list:
    """Delete the rows of a stored table that satisfy a condition; returns the periods touched.

    Rows for which the condition is unknown stay. Periods without such rows are not rewritten.
    """
    table = spark.read.parquet(path)
    touched = periods_of(table.filter(condition), period)
    if touched:
        left = delete_where(in_periods(table, touched, period), condition)
        exchange_periods(spark, left, path, touched, staged_path, period)
    return touched


def update_stored(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    assignments: Mapping[str, Column],
    values: Sequence[str],
    staged_path: str,
    period: str = "fecha",
) -> list:
    """``update_from`` on the periods of ``source`` alone; returns them.

    The period is one of the keys. A key that the source holds twice is an error, before any change.
    """
    if period not in keys:
        raise ValueError("the period must be one of the keys")
    table = spark.read.parquet(path)
    touched = periods_of(source, period)
    if touched:
        rows = update_from(in_periods(table, touched, period), source, keys, assignments, values)
        exchange_periods(spark, rows.select(*table.columns), path, touched, staged_path, period)
    return touched


# --- versions -------------------------------------------------------------------------------------


class Rejected(ValueError):
    """A load that breaks the table's contract; ``rows`` and ``nulls`` are what it counted."""

    def __init__(self, rows: int, nulls: Mapping[str, int]):
        self.rows, self.nulls = rows, dict(nulls)
        found = ", ".join(f"{n} in {name}" for name, n in nulls.items() if n)
        super().__init__(f"NULL in required columns of {rows} rows: {found}")


def _versions(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    return [
        int(name.removeprefix(prefix))
        for name in names_in(spark, folder)
        if name.startswith(prefix) and name.removeprefix(prefix).isdigit()
    ]


def publish(
    df: DataFrame, folder: str, keys: Sequence[str], required: Sequence[str] | None = None
) -> int:
    """Write the next version of a table and make it current if it keeps the contract.

    Rows and NULLs of the required columns (the keys by default) are counted by the job that writes,
    and keys that complete rows repeat stop it, so the data is gone over once. Rows with such a NULL
    are counted, whatever keys they share. A rejected or failed version is left beside the others but
    never becomes current. Returns the number of the version.
    """
    spark = df.sparkSession
    must = list(keys if required is None else required)
    counted = Observation()
    watched = df.observe(
        counted,
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(name).isNull()).alias(f"nulls_{n}") for n, name in enumerate(must)],
    )
    number = max(_versions(spark, folder, "v"), default=0) + 1
    version = f"{folder}/v{number}"
    snapshot(unique_rows(watched, keys, must), version)
    try:
        found = counted.get
    except Py4JJavaError:  # a plan known to be empty counts nothing
        if not spark.read.schema(df.schema).parquet(version).isEmpty():
            raise
    else:
        nulls = {name: found[f"nulls_{n}"] for n, name in enumerate(must)}
        if any(nulls.values()):
            raise Rejected(found["rows"], nulls)
    mark(spark, f"{folder}/published-{number}")
    return number


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest published version of a table."""
    published = _versions(spark, folder, "published-")
    if not published:
        raise ValueError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/v{max(published)}")
