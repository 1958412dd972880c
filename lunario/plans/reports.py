"""Report-shaped files to tidy monthly tables, and the load jobs that merge them.

A report mixes year headers, month rows, yearly means and notes in one label column. The plan is:
label kinds -> year carried down to its months -> month number -> clean cells and dates -> one row
per key. ``within`` names the file (and any entity in it); line order comes from the file's own
line id or from the reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lunario.functions.text import (
    NUMBER,
    amount,
    cell_text,
    is_summary,
    month_number,
    text_label,
    year_label,
)
from lunario.operators.fill import fill_down
from lunario.operators.shape import unpivot_cells
from lunario.operators.upkeep import collapse_duplicates, upsert
from lunario.sources.files import read_aggregate_report, read_rate_report
from lunario.sources.schemas import AGGREGATES, RATE_COLUMNS
from lunario.sources.tables import replace_periods, snapshot

RATE_KEYS = ("moneda", "tipo_tasa", "instrumento", "plazo")


def dated_lines(
    report: DataFrame,
    label: str,
    line: str = "linea",
    within: Sequence[str] = ("archivo",),
    block: str | None = "bloque",
) -> DataFrame:
    """Month rows of a report with ``anio_real``, ``numero_mes`` and their date."""
    text = text_label(F.col(label))
    labelled = (
        report.filter(F.col(label).isNotNull())
        .withColumns(
            {
                "_year": year_label(F.col(label)).cast("int"),
                "numero_mes": F.when(~is_summary(text), month_number(text)),
            }
        )
        # Means and notes neither carry a year nor hold a month, so they need not be shuffled.
        .filter(F.col("_year").isNotNull() | F.col("numero_mes").isNotNull())
    )
    return (
        fill_down(labelled, "_year", "anio_real", line, within, block)
        .filter(F.col("numero_mes").isNotNull())
        .withColumn("_date", F.make_date("anio_real", "numero_mes", F.lit(1)))
        .drop("_year")
    )


def tidy_aggregates(
    report: DataFrame,
    line: str = "linea",
    within: Sequence[str] = ("archivo",),
    block: str | None = "bloque",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Aggregate report -> one row per date (and key) with the seven aggregates as decimals."""
    cells = {name: "base_mon" if name == "base_monetaria" else name for name in AGGREGATES}
    months = dated_lines(report, "anio_mes", line, within, block).select(
        *keys,
        F.col("_date").alias("fecha"),
        *[amount(F.col(cell)).alias(name) for name, cell in cells.items()],
    )
    return collapse_duplicates(months, [*keys, "fecha"])


def tidy_rates(
    report: DataFrame,
    line: str = "linea",
    within: Sequence[str] = ("archivo",),
    block: str | None = "bloque",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rate report -> one row per date, currency, kind, instrument and term; empty cells dropped.

    A cell that is neither empty nor a number (``NaN``, ``Infinity`` and ``5f`` are none) stops the load, as a wrong rate must not pass silently.
    """
    months = dated_lines(report, "fecha", line, within, block).select(
        *keys, F.col("_date").alias("fecha"), *RATE_COLUMNS
    )
    cells = unpivot_cells(months, [*keys, "fecha"], RATE_COLUMNS, RATE_KEYS, "_cell_text")
    text = F.col("_cell_text")
    rate = F.when(text.rlike(NUMBER), text.cast("double")).otherwise(
        F.raise_error(F.concat(F.lit("not a rate: "), text)).cast("double")
    )
    return (
        cells.withColumn("_cell_text", cell_text(text))
        .filter(text.isNotNull())
        .select(*keys, "fecha", *RATE_KEYS, rate.alias("tasa_porcentaje"))
    )


def merge_aggregates(
    bm: DataFrame, tidy: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Monetary aggregates with a tidied report merged in by month."""
    return upsert(bm, tidy.select(*bm.columns), [*keys, "fecha"])


def load_aggregate_csv(
    spark: SparkSession, report_path: str, bm: DataFrame, new_path: str
) -> DataFrame:
    """Job: read a report file, merge it into ``bm``, publish the result at ``new_path``."""
    report = read_aggregate_report(spark, report_path)
    snapshot(merge_aggregates(bm, tidy_aggregates(report)), new_path)
    return spark.read.parquet(new_path)


def load_aggregate_staging(
    spark: SparkSession, staging: DataFrame, bm: DataFrame, new_path: str, line: str = "source_row_id"
) -> DataFrame:
    """Job: as ``load_aggregate_csv``, from a staging table that carries its own line id.

    The staging table is one file, so what its blocks inherit is worked out in one task that reads
    one row for each 100,000 lines.
    """
    tidy = tidy_aggregates(staging, line, within=(), block=None)
    snapshot(merge_aggregates(bm, tidy), new_path)
    return spark.read.parquet(new_path)


def merge_periods(
    spark: SparkSession, tidy: DataFrame, table_path: str, staged_path: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Job: merge a tidied report into a stored table partitioned by ``fecha``, in place.

    The report is evaluated once, into ``staged_path``. Only partitions of its dates are read (the
    dates prune the scan) and rewritten; the files of all others stay as they are. The new files of
    a partition appear together when the job commits.
    """
    stored = spark.read.parquet(table_path)
    if stored.schema["fecha"].dataType != T.DateType():
        raise ValueError("the period must be a DATE column")
    snapshot(tidy.select(*stored.columns), staged_path)
    staged = spark.read.schema(stored.schema).parquet(staged_path)
    touched = stored.join(staged.select("fecha").distinct(), "fecha", "left_semi")
    replace_periods(upsert(touched, staged, [*keys, "fecha"]), table_path, "fecha")
    return spark.read.parquet(table_path)


def load_aggregate_csv_into(
    spark: SparkSession, report_path: str, table_path: str, staged_path: str
) -> DataFrame:
    """Job: as ``load_aggregate_csv``, into a table partitioned by ``fecha``."""
    tidy = tidy_aggregates(read_aggregate_report(spark, report_path))
    return merge_periods(spark, tidy, table_path, staged_path)


def load_rate_csv(spark: SparkSession, report_path: str, new_path: str) -> DataFrame:
    """Job: read a rate report and publish it whole at ``new_path``; the old table is replaced by it."""
    snapshot(tidy_rates(read_rate_report(spark, report_path)), new_path)
    return spark.read.parquet(new_path)


def load_rate_staging(
    spark: SparkSession, staging: DataFrame, new_path: str, line: str = "source_row_id"
) -> DataFrame:
    """Job: as ``load_rate_csv``, from a staging table that carries its own line id."""
    snapshot(tidy_rates(staging, line, within=(), block=None), new_path)
    return spark.read.parquet(new_path)
