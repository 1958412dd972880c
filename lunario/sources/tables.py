"""Parquet tables. Losing a task only repeats it; all writes but ``replace_periods`` go to a path
nobody reads."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet table; with a schema, columns added later read as NULL from older files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_generations(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Parquet table whose files were written over time, with ever more of the declared columns.

    A column that a file does not have yet is NULL there. The footers of all files are compared with
    the declaration first, in a job of their own: a column in two types, in another type than
    declared, or not declared at all is an error, not a silent NULL or a failure of some late task.
    """
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    try:
        found = spark.read.option("mergeSchema", True).parquet(path).schema
    except (PySparkException, Py4JJavaError) as wrong:
        if "CANNOT_MERGE" not in str(wrong):
            raise
        raise ValueError(f"files of {path} disagree on a column's type") from wrong
    types = {field.name: field.dataType for field in declared}
    for field in found:
        if field.name not in types:
            raise ValueError(f"column {field.name} is not declared")
        if field.dataType != types[field.name]:
            raise ValueError(
                f"column {field.name} is {field.dataType.simpleString()}, "
                f"declared {types[field.name].simpleString()}"
            )
    return spark.read.schema(declared).parquet(path)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add rows to a table."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full reload. ``df`` must not read ``path``: write the next version elsewhere instead."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write to a new path; fails if it is taken, so a published version is never changed."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def replace_periods(df: DataFrame, path: str, period: str) -> None:
    """Replace the partitions of a stored table whose periods occur in ``df``, and no others.

    ``df`` may read ``path``: the new files are staged and moved in when the job commits.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(period).parquet(path)
