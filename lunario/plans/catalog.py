"""Base tables and views under the names SQL users know, as temporary views of a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lunario.plans import views
from lunario.plans.views import Tables

# Names under which the views are queried, and the base tables each reads.
VIEWS: dict[str, tuple[Callable[[Tables], DataFrame], tuple[str, ...]]] = {
    "vw_macroeconomico": (
        views.macro_panel, ("ipc", "bm", "credito", "imae", "rin", "tc", "trm")
    ),
    "vw_spread_bancario": (views.bank_spread, ("tasas_interes", "tasa_interbancaria")),
    "vw_tasa_real_colocacion": (views.real_lending_rate, ("tasas_interes", "ipc", "cpi_usa")),
    "vw_inflacion_usa": (views.us_inflation, ("cpi_usa",)),
    "vw_dinamismo_real_financiero": (
        views.real_financial_growth, ("credito", "imae", "tasas_interes", "tasa_interbancaria")
    ),
    "vw_brecha_deslizamiento": (views.crawl_gap, ("ipc", "tc")),
    "vw_estructuraplazos_spread": (views.term_curve, ("tasas_interes",)),
    "vw_exposicion_externa": (views.external_exposure, ("bm",)),
    "vw_crowding_out_spnf": (views.public_sector_weight, ("bm", "credito")),
    "vw_cobertura_res_agregados_monetarios": (views.reserve_coverage, ("rin", "tc", "bm")),
    "vw_paridad_real_de_tasas": (views.rate_parity, ("tasas_interes", "ipc", "cpi_usa")),
    "vw_tipo_cambio_real": (views.real_exchange_rate, ("tc", "ipc", "cpi_usa")),
}

# Base tables queried under a longer name.
TABLE_NAMES = {"tasas_interes": "tasas_interes_bcn"}


def register(
    spark: SparkSession, tables: Tables, base: str = "2011-01-01", partial: bool = False
) -> tuple[list[str], dict[str, list[str]]]:
    """Create a temporary view per base table and per indicator view.

    Returns the names created and, for each view left out, the base tables it misses. Views are left
    out only with ``partial``; otherwise a missing base table is an error. Views are plans, not data:
    a query over one is optimised together with the view, and base tables it does not need are not
    read.
    """
    lacking = {
        name: missing
        for name, (_, needed) in VIEWS.items()
        if (missing := [table for table in needed if table not in tables])
    }
    if lacking and not partial:
        raise ValueError(f"base tables are missing: {lacking}")
    names = []
    for name, df in tables.items():
        alias = TABLE_NAMES.get(name, name)
        df.createOrReplaceTempView(alias)
        names.append(alias)
    for name, (view, _) in VIEWS.items():
        if name not in lacking:
            df = view(tables, base) if view is views.real_exchange_rate else view(tables)
            df.createOrReplaceTempView(name)
            names.append(name)
    return names, lacking
