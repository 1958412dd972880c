"""One query per operator, over the whole test tables.

Operator queries (a to j) run on one series per supplier or customer, so that their work and
output grow with the tables; view and measure queries (k, l) run on the national series, which one
pass over the facts reduces to a row per month.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lunario.functions.dates import month_name, month_start, shift_months
from lunario.functions.numbers import ratio
from lunario.functions.text import amount, month_number, text_label, year_label
from lunario.operators import (
    add_columns,
    attach_constant,
    calendar_dimension,
    clean_simple,
    collapse_duplicates,
    conditional_pivot,
    delete_where,
    densify,
    fill_down,
    fill_within_group,
    key_counts,
    key_violations,
    latest,
    month_calendar,
    period_change,
    previous_value,
    profile,
    running_count,
    spine_join,
    update_from,
    upsert,
)
from lunario.plans import measures, views
from lunario.plans.reports import dated_lines, merge_aggregates, tidy_aggregates, tidy_rates
from lunario.sources.files import COMMA, QUOTED, SEMICOLON, with_line_order
from lunario.sources.schemas import (
    AGGREGATE_REPORT,
    AGGREGATES,
    CURRENCIES,
    inline_rows,
)
from lunario.workload.derive import base_tables, exact_sum
from lunario.workload.render import aggregate_report, rate_cells_report

Query = Callable[[SparkSession, str], DataFrame]

BASE_MONTH = "1995-01-01"
PEAK_YEAR = 1998
LDR_FACTOR = 1.2
KEY = ["entidad"]

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    """Register a query; fractional results are rounded to six decimals for comparison."""

    def add(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: comparable(build(spark, sf_dir.rstrip("/")))
        return build

    return add


def comparable(df: DataFrame) -> DataFrame:
    """Result with DOUBLE fractions of six decimals and BIGINT whole numbers."""

    def plain(name: str, kind: str) -> str:
        if kind == "double" or kind.startswith("decimal"):
            return f"round(cast(`{name}` AS double), 6) AS `{name}`"
        if kind in ("int", "smallint", "tinyint"):
            return f"cast(`{name}` AS bigint) AS `{name}`"
        return f"`{name}`"

    return df.selectExpr(*[plain(name, kind) for name, kind in df.dtypes])


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(spark: SparkSession, sf_dir: str, *names: str, **options) -> dict[str, DataFrame]:
    return base_tables(spark, sf_dir, *names, keyed=True, **options)


def series(df: DataFrame, entity: str, moment: str) -> DataFrame:
    """Rows with their series and month; rows without either belong to no series."""
    dated = df.filter(F.col(entity).isNotNull() & F.col(moment).isNotNull()).select(
        F.col(entity).alias("entidad"), month_start(F.col(moment)).alias("fecha"), *df.columns
    )
    return dated.filter(F.col("fecha").isNotNull())


def customer_months(orders: DataFrame) -> DataFrame:
    """Order totals per customer and month; ``urgente`` is NULL without urgent orders."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return series(orders, "o_custkey", "o_orderdate").groupBy(*KEY, "fecha").agg(
        exact_sum(F.col("o_totalprice")).alias("total"),
        exact_sum(F.when(urgent, F.col("o_totalprice"))).alias("urgente"),
    )


def supplier_months(lineitem: DataFrame) -> DataFrame:
    """Shipped quantity per supplier and month; ``abierto`` is NULL without open lines."""
    is_open = F.col("l_linestatus") == "O"
    return series(lineitem, "l_suppkey", "l_shipdate").groupBy(*KEY, "fecha").agg(
        exact_sum(F.col("l_quantity")).alias("cantidad"),
        exact_sum(F.when(is_open, F.col("l_quantity"))).alias("abierto"),
    )


# --- sources and dimensions -------------------------------------------------------------------


@query("a4_inline_rows")
def _(spark, d):
    names = inline_rows(
        spark,
        [("A", "Aceptado"), ("N", "Nuevo"), ("R", "Rechazado")],
        "l_returnflag string, nombre string",
    )
    totals = fact(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("filas"), exact_sum(F.col("l_extendedprice")).alias("importe")
    )
    return totals.join(names, "l_returnflag").select("nombre", "filas", "importe")


def parsed(lines: DataFrame, schema: str, options: dict[str, str]) -> DataFrame:
    """Text lines read as the CSV readers read a file: same options, declared schema."""
    own = {name: value for name, value in options.items() if name != "encoding"}
    return lines.select(F.from_csv("line", schema, own).alias("_row")).select("_row.*")


@query("a1_comma_csv")
def _(spark, d):
    fields = ("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_totalprice")
    lines = fact(spark, d, "orders").select(F.concat_ws(",", *fields).alias("line"))
    return parsed(lines, "pedido bigint, fecha date, importe double", COMMA)


@query("a2_semicolon_csv")
def _(spark, d):
    day = month_start(F.col("l_shipdate"))
    fields = ("l_orderkey", "l_linenumber", month_name(day), F.lit("Depósitos, año"), "l_tax")
    lines = fact(spark, d, "lineitem").select(F.concat_ws(";", *fields).alias("line"))
    schema = "pedido bigint, linea bigint, mes string, instrumento string, tasa double"
    return parsed(lines, schema, SEMICOLON)


@query("a3_quoted_csv")
def _(spark, d):
    report = aggregate_report(keyed(spark, d, "bm")["bm"], KEY)
    names = AGGREGATE_REPORT.names
    wide = report.select(*[n if n in report.columns else F.lit(None).alias(n) for n in names])
    cells = [F.concat(F.lit('"'), F.coalesce(F.col(n), F.lit("")), F.lit('"')) for n in names]
    months = parsed(
        wide.select(F.concat_ws(",", *cells).alias("line")), AGGREGATE_REPORT.toDDL(), QUOTED
    ).filter(month_number(F.col("anio_mes")).isNotNull())
    return months.groupBy(month_number(F.col("anio_mes")).alias("numero_mes")).agg(
        F.count(F.lit(1)).alias("filas"), F.sum(amount(F.col("m3a"))).alias("m3a")
    )


@query("a5_row_order")
def _(spark, d):
    lines = with_line_order(fact(spark, d, "orders").select("o_orderkey", "_metadata"))
    return running_count(lines, "o_orderkey", "posicion", "linea", ["archivo"], "bloque").select(
        "o_orderkey", "posicion"
    )


@query("a7_month_calendar")
def _(spark, d):
    dates = fact(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("entidad"), month_start(F.col("l_shipdate")).alias("fecha")
    )
    return month_calendar(dates, keys=KEY)


@query("a8_calendar_dim")
def _(spark, d):
    calendar = calendar_dimension(spark, "1994-07-01", "2002-06-01")
    counted = fact(spark, d, "orders").groupBy(
        month_start(F.col("o_orderdate")).alias("fecha")
    ).agg(F.count(F.lit(1)).alias("pedidos"))
    return calendar.join(counted, "fecha", "left").fillna(0, ["pedidos"])


@query("a9_currency_dim")
def _(spark, d):
    currencies = inline_rows(spark, CURRENCIES, "moneda string, nombre string")
    rates = keyed(spark, d, "tasa_interbancaria")["tasa_interbancaria"]
    totals = rates.groupBy("moneda").agg(
        F.count(F.lit(1)).alias("filas"), F.max("tasa").alias("tasa_maxima")
    )
    return totals.join(currencies, "moneda")


@query("a10_clean_simple")
def _(spark, d):
    partial = F.col("o_orderstatus") == "P"
    lost = partial & (F.col("o_orderpriority") == "5-LOW")
    raw = fact(spark, d, "orders").select(
        F.when(lost, "  ").otherwise(F.col("o_orderkey").cast("string")).alias("pedido"),
        F.when(lost, "")
        .when(partial, "n.d.")
        .otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd")))
        .alias("fecha"),
        F.when(lost, " ")
        .otherwise(F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" ")))
        .alias("total"),
    )
    return clean_simple(raw, {"pedido": "bigint", "fecha": "date", "total": "double"})


# --- upkeep -----------------------------------------------------------------------------------


@query("b3_upsert")
def _(spark, d):
    orders = fact(spark, d, "orders")
    day = F.col("o_orderdate")
    target = customer_months(orders.filter(day < F.lit("2000-01-01").cast("timestamp_ntz")))
    source = customer_months(orders.filter(day >= F.lit("1999-07-01").cast("timestamp_ntz")))
    return upsert(target, source, [*KEY, "fecha"])


@query("b4_update_from")
def _(spark, d):
    t = keyed(spark, d, "imae", "tc")
    return update_from(
        t["imae"], t["tc"], [*KEY, "fecha"], {"imae": F.col("imae") * F.col("new_tc")}, ["tc"]
    )


@query("b5_update_window")
def _(spark, d):
    tc = keyed(spark, d, "tc")["tc"]
    return period_change(tc, {"tc": "deslizamiento_cambiario_anual"}, keys=KEY)


@query("b6_delete")
def _(spark, d):
    return delete_where(supplier_months(fact(spark, d, "lineitem")), F.col("abierto") < 20)


@query("b7_add_columns")
def _(spark, d):
    credit = keyed(spark, d, "credito")["credito"]
    return add_columns(credit, {"m1": "decimal(18,4)", "m2": "decimal(18,4)"})


@query("b9_key_violations")
def _(spark, d):
    return key_violations(fact(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- filters ----------------------------------------------------------------------------------


@query("c3_compare")
def _(spark, d):
    return (
        fact(spark, d, "orders")
        .filter(
            (F.col("o_orderstatus") == "F")
            & (F.col("o_totalprice") >= 250000)
            & (F.col("o_orderpriority") != "5-LOW")
        )
        .select("o_orderkey", "o_orderpriority", "o_totalprice")
    )


@query("c4_between")
def _(spark, d):
    rates = keyed(spark, d, "tasas_interes", period=("2000-06-01", "2001-01-01"))["tasas_interes"]
    return rates.filter(
        (F.col("moneda") == views.LOCAL)
        & (F.col("plazo") == views.LONG)
        & F.col("fecha").between(F.lit("2000-06-01").cast("date"), F.lit("2000-12-01").cast("date"))
    ).select(*KEY, "fecha", "moneda", "plazo", "tasa_porcentaje")


@query("c5_in")
def _(spark, d):
    return (
        fact(spark, d, "orders")
        .filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .select("o_orderkey", "o_orderpriority")
    )


@query("c6_not_null")
def _(spark, d):
    months = supplier_months(fact(spark, d, "lineitem"))
    return months.filter(F.col("abierto").isNotNull() & F.col("cantidad").isNotNull())


@query("c7_like")
def _(spark, d):
    return (
        fact(spark, d, "part")
        .filter(F.startswith("p_name", F.lit("red")) & ~F.contains("p_name", F.lit("bolt")))
        .select("p_partkey", "p_name")
    )


@query("c8_year_filter")
def _(spark, d):
    first, after = (F.lit(day).cast("timestamp_ntz") for day in ("1998-01-01", "1999-01-01"))
    year = fact(spark, d, "orders").filter(
        (F.col("o_orderdate") >= first) & (F.col("o_orderdate") < after)
    )
    return year.groupBy(month_start(F.col("o_orderdate")).alias("fecha")).agg(
        F.count(F.lit(1)).alias("pedidos"), exact_sum(F.col("o_totalprice")).alias("total")
    )


# --- joins ------------------------------------------------------------------------------------


@query("d1_spine_join")
def _(spark, d):
    t = keyed(spark, d, "ipc", "imae", "tc", "trm")
    return spine_join(
        t["ipc"].select(*KEY, "fecha", "ipc"),
        [(t["imae"], ["imae"]), (t["tc"], ["tc"]), (t["trm"], ["trm"])],
        [*KEY, "fecha"],
    )


@query("d4_fanout_join")
def _(spark, d):
    return views.reference_with_interbank(keyed(spark, d, "trm", "tasa_interbancaria"), KEY)


@query("d5_deflator_left")
def _(spark, d):
    return views.real_lending_rate(keyed(spark, d, "tasas_interes", "ipc", "cpi_usa"), KEY)


@query("d6_prior_year_join")
def _(spark, d):
    imae = keyed(spark, d, "imae")["imae"]
    return previous_value(imae, {"imae": "imae_anio_anterior"}, mode="join", keys=KEY)


@query("d7_rebase_cross")
def _(spark, d):
    own = keyed(spark, d, "ipc")["ipc"].select(*KEY, "fecha", "ipc")
    national = base_tables(spark, d, "ipc")["ipc"]
    at_base = F.col("fecha") == F.lit(BASE_MONTH).cast("date")
    rebased = attach_constant(own, national, {"_base": F.max(F.when(at_base, F.col("ipc")))})
    return rebased.select(*KEY, "fecha", (F.col("ipc") / F.col("_base") * 100).alias("ipc_base"))


@query("d9_densify")
def _(spark, d):
    return densify(keyed(spark, d, "tc")["tc"], keys=KEY)


# --- aggregates -------------------------------------------------------------------------------


@query("e1_yearly_avg")
def _(spark, d):
    return (
        keyed(spark, d, "imae")["imae"]
        .groupBy(*KEY, F.year("fecha").alias("anio"))
        .agg(F.avg("imae").alias("imae_promedio"))
    )


@query("e2_pivot_term")
def _(spark, d):
    return views.active_terms(keyed(spark, d, "tasas_interes"), KEY)


@query("e3_pivot_sum")
def _(spark, d):
    return conditional_pivot(
        keyed(spark, d, "tasas_interes")["tasas_interes"],
        [*KEY, "fecha", "moneda"],
        "tasa_porcentaje",
        {"activa": F.col("tipo_tasa") == "Activa", "pasiva": F.col("tipo_tasa") == "Pasiva"},
        how="sum",
    )


@query("e4_pivot_currency")
def _(spark, d):
    return conditional_pivot(
        keyed(spark, d, "tasas_interes")["tasas_interes"],
        [*KEY, "fecha", "tipo_tasa", "plazo"],
        "tasa_porcentaje",
        {"tasa_mn": F.col("moneda") == "MN", "tasa_me": F.col("moneda") == "ME"},
    )


@query("e5_profile")
def _(spark, d):
    lines = fact(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("entidad"),
        F.col("l_shipdate").cast("date").alias("fecha"),
        F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("impuesto"),
    )
    return profile(lines, "impuesto", keys=KEY)


@query("e6_key_counts")
def _(spark, d):
    return key_counts(keyed(spark, d, "tasas_interes")["tasas_interes"], ["moneda", "plazo"])


@query("e8_dedup_max")
def _(spark, d):
    lines = fact(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return collapse_duplicates(lines, ["l_orderkey", "l_linenumber"])


@query("e9_peak_gap")
def _(spark, d):
    return views.yearly_inflation(keyed(spark, d, "ipc"), PEAK_YEAR, KEY)


# --- changes and windows ----------------------------------------------------------------------


@query("f1_lag_by_key")
def _(spark, d):
    rates = keyed(spark, d, "tasa_interbancaria")["tasa_interbancaria"]
    return previous_value(rates, {"tasa": "tasa_anterior"}, lag=1, keys=[*KEY, "moneda"])


@query("f2_mom")
def _(spark, d):
    imae = keyed(spark, d, "imae")["imae"]
    return period_change(imae, {"imae": "var_men_imae"}, lag=1, keys=KEY)


@query("f3_yoy_row")
def _(spark, d):
    tc = keyed(spark, d, "tc")["tc"]
    return period_change(tc, {"tc": "var_inter_tc"}, keys=KEY)


@query("f3_yoy_calendar")
def _(spark, d):
    tc = keyed(spark, d, "tc")["tc"]
    return period_change(tc, {"tc": "var_inter_tc"}, mode="calendar", keys=KEY)


@query("f4_lag_densified")
def _(spark, d):
    full = densify(keyed(spark, d, "tc")["tc"], keys=KEY)
    lagged = previous_value(full, {"tc": "tc_anio_anterior"}, keys=KEY)
    return lagged.filter(F.col("tc").isNotNull() & F.col("tc_anio_anterior").isNotNull())


def _staging(spark: SparkSession, d: str) -> DataFrame:
    return aggregate_report(keyed(spark, d, "bm")["bm"], KEY)


def _with_years(lines: DataFrame) -> DataFrame:
    return lines.select(
        *KEY, "source_row_id", year_label(F.col("anio_mes")).cast("int").alias("anio_detectado")
    )


@query("f5_running_count")
def _(spark, d):
    lines = _with_years(_staging(spark, d))
    return running_count(lines, "anio_detectado", "grupo_anio", "source_row_id", KEY).select(
        *KEY, "source_row_id", "grupo_anio"
    )


@query("f6_group_fill")
def _(spark, d):
    # every group of lines opens with its header, so the greatest year so far is the group's
    lines = _with_years(_staging(spark, d))
    return fill_down(lines, "anio_detectado", "anio_real", "source_row_id", KEY).select(
        *KEY, "source_row_id", "anio_real"
    )


@query("f6_group_max")
def _(spark, d):
    lines = fact(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return fill_within_group(lines, "l_quantity", "mayor_cantidad", ["l_orderkey"])


# --- sorts and sets ---------------------------------------------------------------------------


@query("g2_sort_keys")
def _(spark, d):
    rates = keyed(spark, d, "tasas_interes")["tasas_interes"]
    return key_counts(rates, [*KEY, "plazo", "moneda"]).orderBy(*KEY, "plazo", "moneda")


@query("g3_top_n")
def _(spark, d):
    rates = keyed(spark, d, "tasa_interbancaria")["tasa_interbancaria"]
    return latest(rates, 80, ties=[*KEY, "moneda"])


@query("h1_union_all")
def _(spark, d):
    shipped = supplier_months(fact(spark, d, "lineitem"))
    ordered = customer_months(fact(spark, d, "orders"))
    return shipped.select(*KEY, "fecha", F.col("cantidad").alias("valor")).unionByName(
        ordered.select(*KEY, "fecha", F.col("total").alias("valor"))
    )


# --- expressions ------------------------------------------------------------------------------


@query("i4_year_label")
def _(spark, d):
    status = F.col("o_orderstatus")
    label = (
        F.when(status == "F", F.concat(F.year("o_orderdate").cast("string"), F.lit(" p/")))
        .when(status == "O", F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")))
        .otherwise("12")
    )
    return fact(spark, d, "orders").select(
        "o_orderkey", year_label(label).alias("anio"), text_label(label).alias("texto")
    )


@query("i7_try_number")
def _(spark, d):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    cell = (
        F.when(status == "F", F.format_number(price, 2))
        .when(status == "O", F.concat(F.lit("  "), F.translate(F.format_number(price, 2), ",", " ")))
        .otherwise("n.d.")
    )
    return fact(spark, d, "orders").select("o_orderkey", amount(cell).alias("importe"))


@query("i8_guarded_ratio")
def _(spark, d):
    months = supplier_months(fact(spark, d, "lineitem"))
    is_open = F.coalesce("abierto", F.lit(0.0))
    return months.select(
        *KEY, "fecha", ratio(F.col("cantidad") - is_open, is_open).alias("cerrado_por_abierto")
    )


@query("i12_month_number")
def _(spark, d):
    name = month_name(month_start(F.col("o_orderdate")))
    status = F.col("o_orderstatus")
    label = (
        F.when(status == "F", F.concat(F.initcap(name), F.lit(" 1/")))
        .when(status == "O", F.concat(F.upper(name), F.lit("*")))
        .otherwise("Fuente: propia")
    )
    return fact(spark, d, "orders").select("o_orderkey", month_number(label).alias("numero_mes"))


@query("i13_paren_negative")
def _(spark, d):
    balance = F.col("c_acctbal")
    cell = F.when(
        balance < 0, F.concat(F.lit("("), F.format_number(-balance, 2), F.lit(")"))
    ).otherwise(F.format_number(balance, 2))
    return fact(spark, d, "customer").select("c_custkey", amount(cell).alias("saldo"))


@query("i15_make_date")
def _(spark, d):
    day = F.col("l_shipdate")
    built = F.make_date(
        F.year(day), F.when(F.col("l_linestatus") == "F", F.month(day)), F.lit(1)
    )
    return fact(spark, d, "lineitem").groupBy(built.alias("fecha")).agg(
        F.count(F.lit(1)).alias("filas")
    )


@query("i16_shift_month")
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    return fact(spark, d, "orders").select(
        "o_orderkey",
        shift_months(day, 1).alias("mes_siguiente"),
        shift_months(day, -12).alias("anio_anterior"),
    )


@query("i18_month_name")
def _(spark, d):
    return fact(spark, d, "lineitem").groupBy(
        month_name(F.col("l_shipdate").cast("date")).alias("mes_texto")
    ).agg(F.count(F.lit(1)).alias("filas"))


# --- report loads -----------------------------------------------------------------------------


@query("j3_fill_year")
def _(spark, d):
    lines = dated_lines(_staging(spark, d), "anio_mes", "source_row_id", KEY, block=None)
    return lines.select(*KEY, "source_row_id", "anio_real", "numero_mes")


@query("j6_report_tidy")
def _(spark, d):
    return tidy_aggregates(_staging(spark, d), "source_row_id", KEY, block=None, keys=KEY)


@query("j7_unpivot_rates")
def _(spark, d):
    return tidy_rates(rates_of_series(spark, d), "source_row_id", KEY, block=None, keys=KEY)


def rates_of_series(spark: SparkSession, d: str) -> DataFrame:
    """Rate report of every supplier."""
    cells = keyed(spark, d, "tasas_reporte", spread=True)["tasas_reporte"]
    return rate_cells_report(cells, KEY)


@query("j9_staging_tidy")
def _(spark, d):
    staging = aggregate_report(base_tables(spark, d, "bm")["bm"])
    return tidy_aggregates(staging, "source_row_id", within=(), block=None)


@query("j8_report_upsert")
def _(spark, d):
    stored = keyed(spark, d, "bm", period=(None, "2000-01-01"))["bm"].withColumns(
        {name: (F.col(name) + 1).cast("decimal(18,4)") for name in AGGREGATES}
    )
    fresh = keyed(spark, d, "bm", period=("1999-01-01", None))["bm"]
    tidy = tidy_aggregates(
        aggregate_report(fresh, KEY), "source_row_id", KEY, block=None, keys=KEY
    )
    return merge_aggregates(stored, tidy, KEY)


# --- views ------------------------------------------------------------------------------------

_ALL = ("ipc", "cpi_usa", "imae", "tc", "trm", "tasa_interbancaria", "tasas_interes",
        "credito", "rin", "bm")


def view(name: str, *tables: str):
    """Register a query that builds the given base tables and applies a view to them."""

    def add(build: Callable[[dict[str, DataFrame]], DataFrame]):
        @query(name)
        def run(spark, d):
            return build(base_tables(spark, d, *tables))

        return build

    return add


view("k1_macro_panel", "ipc", "bm", "credito", "imae", "rin", "tc", "trm")(views.macro_panel)
view("k2_bank_spread", "tasas_interes", "tasa_interbancaria")(views.bank_spread)
view("k3_real_lending_rate", "tasas_interes", "ipc", "cpi_usa")(views.real_lending_rate)
view("k4_us_inflation", "cpi_usa")(views.us_inflation)
view("k5_real_financial_growth", "credito", "imae", "tasas_interes", "tasa_interbancaria")(
    views.real_financial_growth
)
view("k6_crawl_gap", "ipc", "tc")(views.crawl_gap)
view("k7_term_curve", "tasas_interes")(views.term_curve)
view("k8_external_exposure", "bm")(views.external_exposure)
view("k9_public_sector_weight", "bm", "credito")(views.public_sector_weight)
view("k9_stored_weight", "bm", "credito")(
    lambda t: views.public_sector_weight(t, rounded=True)
)
view("k10_reserve_coverage", "rin", "tc", "bm")(views.reserve_coverage)
view("k11_rate_parity", "tasas_interes", "ipc", "cpi_usa")(views.rate_parity)
view("k12_real_exchange_rate", "tc", "ipc", "cpi_usa")(
    lambda t: views.real_exchange_rate(t, BASE_MONTH)
)
view("k13_yearly_inflation", "ipc")(lambda t: views.yearly_inflation(t, PEAK_YEAR))
view("k14_term_rates_interbank", "tasas_interes", "tasa_interbancaria")(
    views.term_rates_with_interbank
)
view("k15_spread_history", "tasas_interes", "tasa_interbancaria")(views.bank_spread_history)
view("k16_policy_transmission", "trm", "tasa_interbancaria")(
    lambda t: views.policy_transmission(t, rows=80)
)


@view("k17_computed_inflation", "ipc")
def _(t):
    # The official figure starts a year late too, so the year-to-date one stands in for it.
    official = t["ipc"].select(
        "fecha", "ipc", F.coalesce("inflacion_acumulada", F.lit(0.0)).alias("inflacion_interanual")
    )
    return views.computed_inflation({"ipc": official})


@view("k18_yearly_changes", "imae", "credito", "tc")
def _(t):
    changed = [
        views.yearly_change(t, name, name, f"var_inter_{name}") for name in ("imae", "credito", "tc")
    ]
    return reduce(lambda left, right: left.join(right, "fecha", "full_outer"), changed)


view("k19_relative_inflation_gap", "ipc", "tc", "cpi_usa")(views.relative_inflation_gap)
view("k20_reserves_local", "rin", "tc")(
    # in thousands, so that the declared decimal holds them
    lambda t: views.reserves_local_currency(
        t | {"rin": t["rin"].withColumn("rin", F.col("rin") / 1000)}
    )
)


@query("k21_override")
def _(spark, d):
    tc = base_tables(spark, d, "tc")["tc"]
    crawl = period_change(tc, {"tc": "deslizamiento_cambiario_anual"})
    patch = inline_rows(
        spark,
        [(f"1995-{month:02d}-01", 4.75 + month / 100) for month in range(1, 13)],
        "fecha string, deslizamiento_cambiario_anual double",
    ).withColumn("fecha", F.to_date("fecha"))
    return views.override(crawl, patch, "deslizamiento_cambiario_anual")


@query("k22_money_differences")
def _(spark, d):
    bm = base_tables(spark, d, "bm", period=("2000-07-01", None))
    return views.money_differences(bm, "2000-07-01")


@view("k23_series_profile", "cpi_usa")
def _(t):
    return profile(t["cpi_usa"], "cpi_usa")


@query("k24_zero_values")
def _(spark, d):
    lines = fact(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("fecha"), "l_orderkey", "l_linenumber", "l_tax"
    )
    return views.zero_values(lines, "l_tax")


@query("k25_lending_rate_of_year")
def _(spark, d):
    t = base_tables(spark, d, "tasas_interes", "ipc", "cpi_usa")
    return views.real_lending_rate_of_year(t, 2000)


view("k26_rates_listing", "tasas_interes", "tasa_interbancaria")(
    views.rates_with_interbank_listing
)


# --- measures ---------------------------------------------------------------------------------


@query("l1_last_non_blank")
def _(spark, d):
    return measures.kpi(supplier_months(fact(spark, d, "lineitem")), "abierto", KEY)


view("l2_named_kpis", *_ALL)(lambda t: measures.named_kpis(t, BASE_MONTH))
view("l3_weight_buffer", "bm", "credito")(measures.weight_buffer)
view("l4_l5_macro_states", "imae", "ipc")(measures.macro_states)
view("l6_purchasing_power_gap", "ipc", "tc", "cpi_usa")(
    lambda t: measures.purchasing_power_gap(t, tolerance=1.0)
)
view("l7_ldr_zones", "credito", "bm")(lambda t: measures.loan_to_deposit_zones(t, LDR_FACTOR))
view("l8_ldr_centred", "credito", "bm")(lambda t: measures.centred_loan_to_deposit(t, LDR_FACTOR))
view("l9_real_rate_reference", "tc", "ipc", "cpi_usa")(
    lambda t: measures.real_rate_reference(t, BASE_MONTH)
)
view("l10_real_rate_status", "tc", "ipc", "cpi_usa")(
    lambda t: measures.real_rate_status(t, BASE_MONTH)
)
view("l11_correlation", "imae", "credito")(measures.growth_credit_correlation)
view("l12_weight_summary", "bm", "credito")(measures.weight_summary)
view("l13_money_growth", "bm", "rin")(measures.money_growth)
view("l14_inflation_zones", "imae", "ipc", "cpi_usa")(measures.inflation_zones)


@query("l15_fractions")
def _(spark, d):
    rates = keyed(spark, d, "tasas_interes")["tasas_interes"]
    return measures.to_fractions(rates, ["tasa_porcentaje"])


view("l16_term_premium", "tasas_interes", "tasa_interbancaria")(measures.term_premium)
view("l17_external_risk", "bm", "rin", "tc")(measures.external_risk)


# Queries over files and stored tables register themselves here.
from lunario.workload import stored as _stored  # noqa: E402, F401
