"""Report-shaped text written from tidy tables, so that parsing it back can be checked.

Every series becomes a report: per year a header line, month lines, a mean line and a note line,
with numbers as text. ``source_row_id`` orders the lines of a report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lunario.functions.text import MONTHS
from lunario.sources.schemas import AGGREGATES, RATE_COLUMNS

#: Reports from this year on carry footnote marks.
PROVISIONAL_FROM = 2000

_HEADER, _MEAN, _NOTE = 0, 13, 14


def aggregate_report(bm: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Monetary-aggregate report of every series."""
    cells = {
        ("base_mon" if name == "base_monetaria" else name): F.format_number(F.col(name), 4)
        for name in AGGREGATES
    }
    return _report(bm, keys, "anio_mes", cells, AGGREGATES)


def rate_report(rates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Interest-rate report of every series, from one row per rate."""
    wide = rates.groupBy(*keys, "fecha").agg(
        *[
            F.expr(
                f"max(CASE WHEN moneda = '{code}' AND tipo_tasa = '{kind}' AND plazo = '{term}' "
                "THEN tasa_porcentaje END)"
            ).alias(name)
            for name, (code, kind, _, term) in RATE_COLUMNS.items()
        ]
    )
    return rate_cells_report(wide, keys)


def rate_cells_report(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """As ``rate_report``, from one row per period that has a column for each cell of the report;
    cells without a rate are a dash, blank or NULL."""
    wide = cells.select(*keys, "fecha", *[F.round(name, 6).alias(name) for name in RATE_COLUMNS])
    empty = {"3m": "' - '", "6m": "'  '", "9m": "'-'"}
    cells = {
        name: F.expr(f"coalesce(cast({name} AS string), {empty.get(name.split('_')[-1], 'NULL')})")
        for name in RATE_COLUMNS
    }
    return _report(wide, keys, "fecha", cells, list(RATE_COLUMNS))


def _report(
    wide: DataFrame,
    keys: Sequence[str],
    label: str,
    cells: dict[str, Column],
    names: Sequence[str],
) -> DataFrame:
    """Month lines come from the table; header, mean and note lines from its yearly means, which are
    combined map side. Both branches read the table through the same exchange."""
    year, month = F.year("fecha"), F.month("fecha")
    # generated, like the other lines' numbers, so that no filter on labels goes below the exchange
    months = wide.select(*keys, year.alias("_year"), F.explode(F.array(month)).alias("_line"), *names)
    means = wide.groupBy(*keys, year.alias("_year")).agg(
        *[F.avg(F.col(n).cast("double")).alias(n) for n in names]
    )
    of_year = F.explode(F.array(*[F.lit(n) for n in (_HEADER, _MEAN, _NOTE)])).alias("_line")
    lines = months.unionByName(means.select(*keys, "_year", of_year, *names))
    name_of = F.get(F.array(*[F.lit(name) for name in MONTHS]), F.col("_line") - 1)
    line, year = F.col("_line"), F.col("_year")
    provisional = year >= PROVISIONAL_FROM
    return lines.select(
        *keys,
        (year * 100 + line).alias("source_row_id"),
        F.when(
            line == _HEADER,
            F.concat(year.cast("string"), F.when(provisional, " p/").otherwise("")),
        )
        .when(line == _MEAN, "Promedio")
        .when(line == _NOTE, "Fuente: registros propios")
        .otherwise(
            F.concat(F.initcap(name_of), F.when(provisional, " 1/").otherwise(""))
        )
        .alias(label),
        *[F.when(line.between(1, _MEAN), cell).alias(name) for name, cell in cells.items()],
    )
