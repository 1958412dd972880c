"""Declared schemas of base tables and of the two report-shaped files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns and types of the base tables.
TABLES = {
    "ipc": "fecha date, ipc double, inflacion_mensual double, inflacion_interanual double, "
    "inflacion_acumulada double, inflacion_calculada decimal(18,6)",
    "bm": "fecha date, base_monetaria decimal(18,4), m1 decimal(18,4), m1a decimal(18,4), "
    "m2 decimal(18,4), m2a decimal(18,4), m3 decimal(18,4), m3a decimal(18,4)",
    "credito": "fecha date, credito double",
    "imae": "fecha date, imae double",
    "tc": "fecha date, tc double, deslizamiento_cambiario_anual double",
    "rin": "fecha date, rin double, rin_nio decimal(14,6)",
    "trm": "fecha date, trm double",
    "tasa_interbancaria": "fecha date, moneda string, tasa double",
    "tasas_interes": "fecha date, moneda string, tipo_tasa string, instrumento string, "
    "plazo string, tasa_porcentaje double",
    "cpi_usa": "fecha date not null, cpi_usa decimal(13,4) not null",
}

# The seven monetary aggregates kept from the aggregate report, narrow to broad.
AGGREGATES = ("base_monetaria", "m1", "m1a", "m2", "m2a", "m3", "m3a")

# Columns of the aggregate report, by position.
AGGREGATE_CELLS = (
    "base_mon",
    "m1",
    "dep_spnf",
    "m1a",
    "otras_oblig",
    "valores_bcn",
    "m2",
    "otras_spnf",
    "m2a",
    "dep_nores",
    "m3",
    "m3a",
)

# Rate kind, instrument and term of the nine cells the rate report has per currency.
RATE_CELLS = {
    "pasiva_ahorro": ("Pasiva", "Depósitos de ahorro", "Sin plazo fijo"),
    "pasiva_1m": ("Pasiva", "Depósitos a Plazo", "1 mes"),
    "pasiva_3m": ("Pasiva", "Depósitos a Plazo", "3 meses"),
    "pasiva_6m": ("Pasiva", "Depósitos a Plazo", "6 meses"),
    "pasiva_9m": ("Pasiva", "Depósitos a Plazo", "9 meses"),
    "pasiva_1y": ("Pasiva", "Depósitos a Plazo", "1 año"),
    "pasiva_mas1y": ("Pasiva", "Depósitos a Plazo", "Más de 1 año"),
    "activa_corto": ("Activa", "Préstamo", "Corto Plazo"),
    "activa_largo": ("Activa", "Préstamo", "Largo Plazo"),
}

# Currency codes and names.
CURRENCIES = (("MN", "Córdobas"), ("ME", "Dólares"))

#: Attributes of every rate-report column: currency, then the cell's own three.
RATE_COLUMNS = {
    f"{code.lower()}_{cell}": (code, *labels)
    for code, _ in CURRENCIES
    for cell, labels in RATE_CELLS.items()
}


def all_text(names: Sequence[str]) -> T.StructType:
    """Schema with every column a string."""
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


AGGREGATE_REPORT = all_text(["anio_mes", *AGGREGATE_CELLS])
RATE_REPORT = all_text(["fecha", *RATE_COLUMNS])


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table written in the code: currency names, manual corrections.

    It is a VALUES list, whose size the planner knows, so joins on it are broadcast from the start.
    """
    fields = T.StructType.fromDDL(schema)
    marks = ", ".join(
        "(" + ", ".join(f":p{r}_{c}" for c in range(len(fields))) + ")" for r in range(len(rows))
    )
    values = {f"p{r}_{c}": value for r, row in enumerate(rows) for c, value in enumerate(row)}
    names = ", ".join(f"`{field.name}`" for field in fields)
    table = spark.sql(f"SELECT * FROM VALUES {marks} AS t({names})", values)
    return table.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
