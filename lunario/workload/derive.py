"""Monthly base tables computed from the order and shipment facts.

All base tables a query asks for come from one pass over each fact table: a single map-side
combined aggregate with one (conditional) sum per measure, shuffling at most one row per period,
key and task. The aggregate is then split into tables by ``stack``, which keeps column pruning
from turning the branches into different aggregates, so Spark reuses the one exchange for all of
them. Only the measures asked for are summed, and only their columns are read.

The rate report of every series is the exception: its 18 sums and counts of a month are as wide as
the few lines they are made of, so combining them map side shuffles no less and holds a wide row for
nearly every line of a split. Its lines are dealt to tasks by series and month instead (``spread``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lunario.functions.dates import month_start
from lunario.operators.change import period_change
from lunario.sources.schemas import AGGREGATES, RATE_CELLS, RATE_COLUMNS
from lunario.sources.shared import bytes_of

CENTS = 100

#: Bytes of a fact's files whose lines one task sums when they are spread; more files, more tasks.
SPREAD_BYTES = 8 << 20

# Rate kind, instrument and term of each return flag.
FLAG_RATES = {
    "A": ("Activa", "Préstamo", "Corto Plazo"),
    "N": ("Activa", "Préstamo", "Largo Plazo"),
    "R": ("Pasiva", "Depósitos de ahorro", "Sin plazo fijo"),
}
# Currency of each line status.
STATUS_CURRENCY = {"O": "MN", "F": "ME"}

_RATE_ROWS = [
    (status, flag, (currency, *labels))
    for status, currency in STATUS_CURRENCY.items()
    for flag, labels in FLAG_RATES.items()
]


# Lines of a currency by return flag and line number, one kind of line for each cell of the report.
_CELL_ROWS = [
    (status, f"l_returnflag = '{'ANR'[n // 3]}' AND l_linenumber % 3 = {n % 3}")
    for status in STATUS_CURRENCY
    for n in range(len(RATE_CELLS))
]


def exact_sum(value: Column) -> Column:
    """Sum of two-decimal amounts without rounding error: whole cents add up exactly, in any order."""
    return F.sum(F.rint(value * CENTS).cast("long")) / CENTS


def _total(column: str, condition: str | None = None) -> str:
    """``exact_sum`` of a column as SQL text, over the rows where the condition holds."""
    value = column if condition is None else f"CASE WHEN {condition} THEN {column} END"
    return f"sum(cast(rint({value} * {CENTS}) AS bigint)) / {CENTS}"


def _mean(column: str, condition: str | None = None, factor: int = 1) -> str:
    rows = "count(*)" if condition is None else f"count_if({condition})"
    scaled = f"{factor} * ({_total(column, condition)})" if factor != 1 else _total(column, condition)
    return f"{scaled} / nullif({rows}, 0)"


# Cell 0-14 of an order: priority digit (0-4) in steps of three, status within the step.
_CELL = (
    "(cast(substring(o_orderpriority, 1, 1) AS int) - 1) * 3"
    " + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
)

#: Value of every row each shipment-based table has per period.
_SHIPMENT_MEASURES = {
    "ipc": [_mean("l_extendedprice")],
    "cpi_usa": [_mean("l_extendedprice", "l_linestatus = 'F'")],
    "imae": [_total("l_quantity")],
    "tc": [_mean("l_quantity", "l_linestatus = 'O'")],
    "trm": [_mean("l_tax", "l_returnflag = 'A'", 100)],
    "tasa_interbancaria": [_mean("l_tax", f"l_linestatus = '{s}'", 100) for s in STATUS_CURRENCY],
    "tasas_interes": [
        _mean("l_discount", f"l_linestatus = '{s}' AND l_returnflag = '{f}'", 100)
        for s, f, _ in _RATE_ROWS
    ],
    "tasas_reporte": [
        _mean("l_discount", f"l_linestatus = '{s}' AND {kind}", 100) for s, kind in _CELL_ROWS
    ],
}

#: Value of every row each order-based table has per period; ``bm`` is one wide row.
_ORDER_MEASURES = {
    "credito": [_total("o_totalprice", "o_orderstatus <> 'P'")],
    "rin": [_total("o_totalprice", "o_orderpriority = '1-URGENT'") + " / 20"],
    "bm": [_total("o_totalprice", f"{_CELL} < {limit}") for limit in (3, 5, 7, 9, 11, 13, 15)],
}

#: Tables of one wide row per period.
_WIDE = ("bm", "tasas_reporte")

_SHIPMENTS = ("lineitem", "l_shipdate", "l_suppkey", _SHIPMENT_MEASURES)
_ORDERS = ("orders", "o_orderdate", "o_custkey", _ORDER_MEASURES)


def base_tables(
    spark: SparkSession,
    sf_dir: str,
    *names: str,
    keyed: bool = False,
    period: tuple[str | None, str | None] | None = None,
    spread: bool = False,
) -> dict[str, DataFrame]:
    """The named base tables; ``keyed`` adds ``entidad``, one series per supplier or customer.

    ``period`` (first month, first month after; None is open) limits the scan on the raw timestamp,
    which reaches the Parquet reader. ``spread`` deals the lines of keyed tables to tasks by series
    and month before they are summed, as many tasks as the files need, and then the months by series.
    """
    tables: dict[str, DataFrame] = {}
    for source in (_SHIPMENTS, _ORDERS):
        wanted = [name for name in names if name in source[3]]
        if wanted:
            lines, tasks = _monthly(spark, sf_dir, source, keyed, period), None
            if keyed and spread:
                tasks = spread_tasks(spark, f"{sf_dir}/{source[0]}.parquet")
            tables |= _split(lines, source, wanted, keyed, tasks)
    if "ipc" in tables:
        tables["ipc"] = _with_inflation(tables["ipc"], ["entidad"] if keyed else [])
    return tables


def spread_tasks(spark: SparkSession, path: str) -> int:
    """How many tasks the lines of a fact are dealt to."""
    return max(math.ceil(bytes_of(spark, path) / SPREAD_BYTES), spark.sparkContext.defaultParallelism)


def _monthly(spark, sf_dir: str, source, keyed: bool, period) -> DataFrame:
    file, moment, entity, _ = source
    fact = spark.read.parquet(f"{sf_dir}/{file}.parquet").filter(F.col(moment).isNotNull())
    first, after = period or (None, None)
    if first:
        fact = fact.filter(F.col(moment) >= F.lit(first).cast("timestamp_ntz"))
    if after:
        fact = fact.filter(F.col(moment) < F.lit(after).cast("timestamp_ntz"))
    dated = fact.withColumn("fecha", month_start(F.col(moment))).filter(F.col("fecha").isNotNull())
    if not keyed:
        return dated
    # Stated once here, the key's not-NULL filter is the same in every branch joined later.
    return dated.filter(F.col(entity).isNotNull()).withColumnRenamed(entity, "entidad")


def _split(
    fact: DataFrame, source, wanted: Sequence[str], keyed: bool, tasks: int | None
) -> dict[str, DataFrame]:
    ids = ["entidad", "fecha"] if keyed else ["fecha"]
    if tasks:
        fact = fact.repartition(tasks, *ids)
    held = {name: [f"_{name}_{i}" for i in range(len(source[3][name]))] for name in wanted}
    monthly = fact.groupBy(*ids).agg(
        *[
            F.expr(measure).alias(alias)
            for name, aliases in held.items()
            for measure, alias in zip(source[3][name], aliases, strict=True)
        ]
    )
    if tasks:  # below the stack, so that all branches read one exchange and sum nothing again
        monthly = monthly.repartition(tasks, "entidad")
    rows = [
        (name, position, values)
        for name, columns in held.items()
        for position, values in enumerate([columns] if name in _WIDE else [[c] for c in columns])
    ]
    width = max(len(values) for _, _, values in rows)
    outputs = ", ".join(f"_v{i}" for i in range(width))
    cells = ", ".join(
        ", ".join([f"'{name}'", str(position), *values, *["NULL"] * (width - len(values))])
        for name, position, values in rows
    )
    stacked = monthly.selectExpr(
        *ids, f"stack({len(rows)}, {cells}) AS (_table, _row, {outputs})"
    )
    return {name: _table(stacked, ids, name) for name in wanted}


def _table(stacked: DataFrame, ids: Sequence[str], name: str) -> DataFrame:
    present, columns = "_v0", [f"_v0 AS {name}"]
    if name == "bm":
        present, columns = "_v6", [
            f"cast(_v{i} AS decimal(18,4)) AS {a}" for i, a in enumerate(AGGREGATES)
        ]
    elif name == "tasas_reporte":
        present = f"coalesce({', '.join(f'_v{i}' for i in range(len(RATE_COLUMNS)))})"
        columns = [f"_v{i} AS {c}" for i, c in enumerate(RATE_COLUMNS)]
    elif name == "tasa_interbancaria":
        columns = [f"{_label(STATUS_CURRENCY.values())} AS moneda", "_v0 AS tasa"]
    elif name == "tasas_interes":
        names = ("moneda", "tipo_tasa", "instrumento", "plazo")
        columns = [f"{_label(row[2][i] for row in _RATE_ROWS)} AS {n}" for i, n in enumerate(names)]
        columns.append("_v0 AS tasa_porcentaje")
    own = stacked.filter(f"_table = '{name}' AND {present} IS NOT NULL")
    return own.selectExpr(*ids, *columns)


def _label(labels: Iterable[str]) -> str:
    """The label at a row's position, as SQL text."""
    return f"array({', '.join(repr(label) for label in labels)})[_row]"


def _with_inflation(ipc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Price index with monthly, yearly and year-to-date inflation, each from its own comparison row."""
    before = Window.partitionBy(*keys).orderBy("fecha").rowsBetween(Window.unboundedPreceding, -1)
    december = F.last(F.when(F.month("fecha") == 12, F.col("ipc")), ignorenulls=True).over(before)
    changed = period_change(ipc, {"ipc": "inflacion_mensual"}, lag=1, keys=keys)
    changed = period_change(changed, {"ipc": "inflacion_interanual"}, lag=12, keys=keys)
    return changed.withColumn(
        "inflacion_acumulada", (F.col("ipc") - december) / F.nullif(december, F.lit(0)) * 100
    )
