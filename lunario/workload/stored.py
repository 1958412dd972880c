"""Queries over files and stored tables: what is written by one job and read, changed or published by
others. All of it is derived from the test tables and lies in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lunario.functions.dates import month_name, month_start
from lunario.functions.text import amount, month_number
from lunario.operators import calendar_dimension, upsert
from lunario.plans import kept, refresh, stored, view_sql, views
from lunario.plans.reports import (
    load_aggregate_csv,
    load_aggregate_staging,
    load_rate_csv,
    merge_periods,
)
from lunario.sources.files import (
    read_aggregate_report,
    read_checked_table,
    read_semicolon_table,
    write_lines,
    write_semicolon_table,
)
from lunario.sources.schemas import AGGREGATE_REPORT, AGGREGATES, RATE_REPORT
from lunario.sources.shared import new_path
from lunario.sources.tables import append, read_generations, read_table, replace, snapshot
from lunario.workload.derive import base_tables, exact_sum, spread_tasks
from lunario.workload.queries import (
    BASE_MONTH,
    KEY,
    customer_months,
    fact,
    keyed,
    query,
    rates_of_series,
    series,
    supplier_months,
)
from lunario.workload.render import aggregate_report

#: Bytes of an input split while a report is loaded, so that its lines come from many tasks.
SPLIT_BYTES = 1 << 16


def _before(column: str, day: str):
    return F.col(column) < F.lit(day).cast("timestamp_ntz")


# --- files ------------------------------------------------------------------------------------


@query("a1_comma_file")
def _(spark, d):
    """Good and rejected rows of comma-separated files with headers; the other orders are broken."""
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    price, priority = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_orderpriority")
    quoted = F.concat(F.lit('"'), price, F.lit('"'))
    line = (
        F.when(F.col("o_orderstatus") == "P", F.concat_ws(",", key, F.concat(F.lit('"'), day), price))
        .when(priority == "5-LOW", F.concat_ws(",", key, day))
        .when(priority == "4-NOT SPECIFIED", F.concat_ws(",", key, day, price, F.lit("de más")))
        .when(priority == "3-MEDIUM", F.concat_ws(",", key, F.lit("n.d."), price))
        .otherwise(F.concat_ws(",", key, day, quoted))
    )
    path = new_path(spark, "comma")
    write_lines(fact(spark, d, "orders").select(line.alias("l")), path, "pedido,fecha,importe")
    read = read_checked_table(spark, path, "pedido bigint, fecha date, importe double")
    return read.good.withColumns(
        {"texto": F.lit(None).cast("string"), "motivo": F.lit(None).cast("string")}
    ).unionByName(read.rejected.select("texto", "motivo"), allowMissingColumns=True)


@query("a2_code_page_file")
def _(spark, d):
    """Files in code page 1252 with signs that ISO-8859-1 lacks, written and read back."""
    flag = F.col("l_returnflag")
    note = F.when(flag == "A", "€ 5 – “niño”").when(flag == "N", "Šalda…ž ‰ ™").otherwise("¿Qué? ½ ü")
    lines = fact(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pedido"),
        F.col("l_linenumber").alias("linea"),
        month_name(month_start(F.col("l_shipdate"))).alias("mes"),
        note.alias("nota"),
        F.col("l_tax").alias("tasa"),
    )
    path = new_path(spark, "semicolon")
    write_semicolon_table(lines, path)
    schema = "pedido bigint, linea bigint, mes string, nota string, tasa double"
    return read_semicolon_table(spark, path, schema)


def _report_files(report: DataFrame, path: str) -> None:
    """Aggregate reports as quoted files with headers, one entity's lines after the other's."""
    names = AGGREGATE_REPORT.names
    wide = report.select(
        *KEY, "source_row_id", *[n if n in report.columns else F.lit(None).alias(n) for n in names]
    )
    cells = [F.concat(F.lit('"'), F.coalesce(F.col(n), F.lit("")), F.lit('"')) for n in names]
    ordered = wide.repartitionByRange(*KEY).sortWithinPartitions(*KEY, "source_row_id")
    write_lines(ordered.select(F.concat_ws(",", *cells).alias("l")), path, ",".join(names))


@query("a3_quoted_file")
def _(spark, d):
    path = new_path(spark, "quoted")
    _report_files(aggregate_report(keyed(spark, d, "bm")["bm"], KEY), path)
    number = month_number(F.col("anio_mes"))
    months = read_aggregate_report(spark, path).filter(number.isNotNull())
    return months.groupBy(number.alias("numero_mes")).agg(
        F.count(F.lit(1)).alias("filas"), F.sum(amount(F.col("m3a"))).alias("m3a")
    )


@query("j_load_csv")
def _(spark, d):
    """The whole load job: report files of many splits, tidied and merged into a stored table.

    The files hold every customer's report, so a month has many lines and the greatest figures stay.
    """
    path = new_path(spark, "report")
    _report_files(aggregate_report(keyed(spark, d, "bm")["bm"], KEY), path)
    held = base_tables(spark, d, "bm", period=(None, "1997-01-01"))["bm"].withColumn(
        "fecha", F.add_months("fecha", -36)
    )
    with small_splits(spark):
        return load_aggregate_csv(spark, path, held, new_path(spark, "bm"))


class small_splits:
    """Input splits of SPLIT_BYTES for the jobs inside."""

    NAMES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = [self.conf.get(name) for name in self.NAMES]
        for name, value in zip(self.NAMES, (SPLIT_BYTES, 0), strict=True):
            self.conf.set(name, str(value))

    def __exit__(self, *_) -> None:
        for name, value in zip(self.NAMES, self.before, strict=True):
            self.conf.set(name, value)


@query("j7_load_rates")
def _(spark, d):
    """Full reload of the rates from report files in code page 1252.

    The files grow in number, not in size, so that the lines of one are few enough for a task.
    """
    tasks = spread_tasks(spark, f"{d}/lineitem.parquet")
    ordered = rates_of_series(spark, d).repartitionByRange(tasks, *KEY).sortWithinPartitions(
        *KEY, "source_row_id"
    )
    path = new_path(spark, "rates")
    write_semicolon_table(ordered.select(*RATE_REPORT.names), path)
    return load_rate_csv(spark, path, new_path(spark, "rates-table"))


# --- stored tables ----------------------------------------------------------------------------


@query("b1_append")
def _(spark, d):
    path, lines = new_path(spark, "append"), fact(spark, d, "lineitem")
    append(supplier_months(lines.filter(_before("l_shipdate", "1998-01-01"))), path)
    append(supplier_months(lines.filter(~_before("l_shipdate", "1998-01-01"))), path)
    return read_table(spark, path, "entidad bigint, fecha date, cantidad double, abierto double")


@query("b2_full_reload")
def _(spark, d):
    path, orders = new_path(spark, "reload"), fact(spark, d, "orders")
    replace(customer_months(orders.filter(F.col("o_orderstatus") == "P")), path)
    replace(customer_months(orders), path)
    return read_table(spark, path)


@query("b8_snapshot")
def _(spark, d):
    """A table that changes after its snapshot was taken; the snapshot does not."""
    path, copy = new_path(spark, "base"), new_path(spark, "snapshot")
    months = supplier_months(fact(spark, d, "lineitem"))
    append(months, path)
    snapshot(read_table(spark, path), copy)
    append(months, path)
    sides = [
        read_table(spark, p).select("*", F.lit(name).alias("copia"))
        for name, p in (("base", path), ("respaldo", copy))
    ]
    return sides[0].unionByName(sides[1]).groupBy("copia", *KEY).agg(
        F.count(F.lit(1)).alias("filas"), exact_sum(F.col("cantidad")).alias("cantidad")
    )


@query("b11_load_job")
def _(spark, d):
    """The parameterised job on a stored staging table: parse, merge, publish, and once more."""
    staged = new_path(spark, "staging")
    snapshot(aggregate_report(base_tables(spark, d, "bm", period=("1997-01-01", None))["bm"]), staged)
    held = base_tables(spark, d, "bm", period=(None, "1998-01-01"))["bm"].withColumns(
        {name: (F.col(name) + 1).cast("decimal(18,4)") for name in AGGREGATES}
    )
    staging = read_table(spark, staged)
    first = load_aggregate_staging(spark, staging, held, new_path(spark, "bm"))
    return load_aggregate_staging(spark, staging, first, new_path(spark, "bm"))


@query("b4_stored_update")
def _(spark, d):
    """Update join inside a table stored by month: only the months of the source are rewritten."""
    t, path = keyed(spark, d, "imae", "tc"), new_path(spark, "imae")
    stored.store(t["imae"], path)
    source = t["tc"].filter(F.year("fecha") == 1997)
    stored.update_stored(
        spark, path, source, [*KEY, "fecha"], {"imae": F.col("imae") * F.col("new_tc")}, ["tc"],
        new_path(spark, "staged"),
    )
    return spark.read.parquet(path)


@query("b6_stored_delete")
def _(spark, d):
    """Delete inside a table stored by month: one month is emptied, others lose some rows."""
    path = new_path(spark, "months")
    stored.store(supplier_months(fact(spark, d, "lineitem")), path)
    emptied = F.col("fecha") == F.lit("1997-03-01").cast("date")
    small = (F.col("abierto") < 20) & (F.year("fecha") == 1998)
    stored.delete_stored(spark, path, emptied | small, new_path(spark, "staged"))
    return spark.read.parquet(path)


@query("b7_generations")
def _(spark, d):
    """Two generations of files: the later ones have a column more."""
    path, orders = new_path(spark, "generations"), fact(spark, d, "orders")
    months = [
        customer_months(orders.filter(when))
        for when in (_before("o_orderdate", "1998-01-01"), ~_before("o_orderdate", "1998-01-01"))
    ]
    append(months[0].select(*KEY, "fecha", "total"), path)
    append(months[1], path)
    return read_generations(spark, path, "entidad bigint, fecha date, total double, urgente double")


@query("b9_checked_load")
def _(spark, d):
    """A good load, then one with NULL keys: the first stays current, the second is counted."""
    folder, months = new_path(spark, "versions"), supplier_months(fact(spark, d, "lineitem"))
    stored.publish(months, folder, [*KEY, "fecha"])
    year = F.year("fecha") == 1997
    broken = months.filter(year & F.col("abierto").isNull() | ~year).select(
        *KEY, F.when(~year, F.col("fecha")).alias("fecha"), "cantidad", "abierto"
    )
    try:
        stored.publish(broken, folder, [*KEY, "fecha", "cantidad", "abierto"], ["fecha", "cantidad"])
        rows, nulls = -1, {"fecha": -1}
    except stored.Rejected as found:
        rows, nulls = found.rows, found.nulls
    return stored.current(spark, folder).withColumns(
        {"filas_rechazadas": F.lit(rows).cast("bigint"), "nulos": F.lit(nulls["fecha"]).cast("bigint")}
    )


@query("b10_persistent_view")
def _(spark, d):
    """A view read by another session than the one that created it, by its SQL name alone."""
    names = ("tasas_interes", "ipc", "cpi_usa")
    paths = {name: new_path(spark, name) for name in names}
    for name, table in base_tables(spark, d, *names).items():
        snapshot(table, paths[name])
    database = f"indicadores_{uuid.uuid4().hex}"
    view_sql.create(spark, database, paths, BASE_MONTH)
    found = spark.newSession().sql(f"SELECT * FROM {database}.vw_paridad_real_de_tasas")
    path = new_path(spark, "view")
    snapshot(found, path)
    spark.sql(f"DROP DATABASE {database} CASCADE")  # the tables' files are not the catalogue's
    return spark.read.parquet(path)


@query("c8_pruned_scan")
def _(spark, d):
    """Months of a stored table chosen by attributes of a stored calendar."""
    return pruned_months(spark, d).groupBy("fecha").agg(
        F.count(F.lit(1)).alias("filas"), exact_sum(F.col("total")).alias("total")
    )


def pruned_months(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the second quarter of 1997: the calendar's filter prunes the partitions read."""
    path, calendar = new_path(spark, "months"), new_path(spark, "calendar")
    stored.store(customer_months(fact(spark, d, "orders")), path)
    snapshot(calendar_dimension(spark, "1990-01-01", "2009-12-01"), calendar)
    months = spark.read.parquet(calendar).filter("anio = 1997 AND trimestre = 2").select("fecha")
    return spark.read.parquet(path).join(months, "fecha")


# --- kept figures and refreshed views ---------------------------------------------------------

#: Months from which the last correction blanks a figure.
BLANK_FROM = "2001-03-01"


def _flag_months(lines: DataFrame) -> DataFrame:
    """Open quantity per supplier, return flag and month."""
    is_open = F.col("l_linestatus") == "O"
    return series(lines, "l_suppkey", "l_shipdate").groupBy(*KEY, "l_returnflag", "fecha").agg(
        exact_sum(F.when(is_open, F.col("l_quantity"))).alias("abierto")
    )


@query("l1_kept_state")
def _(spark, d):
    """Last open quantity of each supplier, kept through three merges into the stored table."""
    table, state = new_path(spark, "table"), new_path(spark, "state")
    lines = fact(spark, d, "lineitem")
    keys = [*KEY, "l_returnflag", "fecha"]
    all_months = _flag_months(lines)
    stored.store(_flag_months(lines.filter(_before("l_shipdate", "2000-01-01"))), table)
    kept.keep_state(spark, table, state, "abierto", KEY)
    late = F.col("fecha") >= F.lit(BLANK_FROM).cast("date")
    changes = [
        all_months.filter(F.year("fecha") == 2000),
        all_months.filter(F.year("fecha") >= 2001),
        all_months.filter(late & (F.col("l_returnflag") != "R")).withColumn(
            "abierto", F.lit(None).cast("double")
        ),
    ]
    for change in changes:
        staged = new_path(spark, "staged")
        merge_periods(spark, change, table, staged, [*KEY, "l_returnflag"])
        touched = stored.periods_of(spark.read.parquet(staged))
        kept.renew_state(spark, table, state, touched, new_path(spark, "staged"), "abierto", KEY)
    return kept.last_known(spark, state, KEY)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    snapshot(df, path)
    return df.sparkSession.read.parquet(path)


def _earlier(df: DataFrame, values: list[str], every: int, keyed_by: str | None) -> DataFrame:
    """The table before an upsert: some months had other values, one was missing."""
    own = F.col(keyed_by) % every == 0 if keyed_by else F.lit(True)
    other = own & F.col("fecha").between(F.lit("1997-03-01").cast("date"), F.lit("1997-05-01").cast("date"))
    absent = own & (F.col("fecha") == F.lit("1998-02-01").cast("date"))
    return df.filter(~absent).withColumns(
        {v: F.when(other, F.col(v) * 2).otherwise(F.col(v)).cast(df.schema[v].dataType) for v in values}
    )


@query("k4_refresh")
def _(spark, d):
    now = {"cpi_usa": _written(keyed(spark, d, "cpi_usa")["cpi_usa"], "cpi")}
    was = {"cpi_usa": _earlier(now["cpi_usa"], ["cpi_usa"], 3, "entidad")}
    held = _written(views.us_inflation(was, KEY), "held")
    touched = refresh.changed_rows(was["cpi_usa"], now["cpi_usa"], KEY)
    return refresh.refresh_us_inflation(now, held, touched, KEY)


@query("k6_refresh")
def _(spark, d):
    """Crawl gap of every supplier after exchange rates changed and a missing month came in."""
    t = keyed(spark, d, "ipc", "tc")
    now = {"ipc": _written(t["ipc"], "ipc"), "tc": _written(t["tc"], "tc")}
    was = now | {"tc": _earlier(now["tc"], ["tc"], 3, "entidad")}
    crawl_was = _written(views.yearly_crawl(was, KEY), "crawl")
    held = _written(views.gap_of_crawl(crawl_was, KEY), "held")
    touched = refresh.changed_rows(was["tc"], now["tc"], KEY)
    crawl = _written(refresh.refresh_crawl(now, crawl_was, touched, KEY), "crawl")
    return refresh.refresh_crawl_gap(crawl_was, crawl, held, KEY)


@query("k10_refresh")
def _(spark, d):
    now = {n: _written(t, n) for n, t in base_tables(spark, d, "rin", "tc", "bm").items()}
    was = now | {"bm": _earlier(now["bm"], list(AGGREGATES), 1, None)}
    held = _written(views.reserve_coverage(was), "held")
    touched = refresh.changed_rows(was["bm"], now["bm"])
    return refresh.refresh_reserve_coverage(now, held, touched)


@query("b3_stored_upsert")
def _(spark, d):
    """Upsert into a table stored by month: months that the source lacks are not rewritten."""
    path, orders = new_path(spark, "months"), fact(spark, d, "orders")
    stored.store(customer_months(orders.filter(_before("o_orderdate", "2000-01-01"))), path)
    fresh = customer_months(orders.filter(~_before("o_orderdate", "1999-07-01"))).withColumn(
        "urgente", F.lit(None).cast("double")
    )
    touched = stored.periods_of(fresh)
    merged = upsert(stored.in_periods(spark.read.parquet(path), touched), fresh, [*KEY, "fecha"])
    stored.exchange_periods(spark, merged, path, touched, new_path(spark, "staged"))
    return spark.read.parquet(path)
