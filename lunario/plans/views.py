"""Indicator views over a mapping of base tables.

Every view takes the base tables by name and returns a DataFrame. ``keys`` names further series
columns that all the tables used carry (a country, an institution); joins and windows then run by
(keys, date), so one call serves any number of series. Without keys a table is one monthly series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lunario.functions.dates import month_name
from lunario.functions.numbers import ratio
from lunario.functions.states import State, classify
from lunario.operators.change import period_change, previous_value
from lunario.operators.profile import latest
from lunario.operators.shape import attach_constant, conditional_pivot, spine_join
from lunario.operators.upkeep import update_from
from lunario.sources.schemas import AGGREGATES

Tables = Mapping[str, DataFrame]
Keys = Sequence[str]

# Labels of rate kinds, terms and currencies in the data.
ACTIVE = "Activa"
SHORT = "Corto Plazo"
LONG = "Largo Plazo"
LOCAL = "MN"
FOREIGN = "ME"

# State labels and their limits.
ANCHOR_GOOD, ANCHOR_GOOD_LIMIT = "Anclaje Exitoso", 1.5
ANCHOR_IMPORTED, ANCHOR_IMPORTED_LIMIT = "Presión por Costos Importados", 4
ANCHOR_SHOCK = "Desalineamiento / Shock Estructural"
CURVE_NORMAL, CURVE_FLAT, CURVE_INVERTED = "Curva normal", "Curva plana", "Curva invertida"
POLICY_PASSED, POLICY_PASSED_LIMIT = "Transmisión Efectiva", 0.5
POLICY_MISSED = "Desvío de Política"


def macro_panel(t: Tables, keys: Keys = ()) -> DataFrame:
    """All headline series side by side; every month of the price index is kept."""
    on = [*keys, "fecha"]
    inflation = ["inflacion_mensual", "inflacion_interanual", "inflacion_acumulada"]
    panel = spine_join(
        t["ipc"].select(*on, "ipc", *inflation),
        [
            (t["bm"], ["base_monetaria"]),
            (t["credito"], ["credito"]),
            (t["imae"], ["imae"]),
            (t["rin"], ["rin"]),
            (t["tc"], ["tc"]),
            (t["trm"], ["trm"]),
        ],
        on,
    )
    return panel.select(
        *on, "base_monetaria", "credito", "imae", "ipc", *inflation, "rin", "tc", "trm"
    )


def active_terms(t: Tables, keys: Keys = ()) -> DataFrame:
    """Short and long active rate per month and currency; NULL where a month has none."""
    active = F.col("tipo_tasa") == ACTIVE
    return conditional_pivot(
        t["tasas_interes"],
        [*keys, "fecha", "moneda"],
        "tasa_porcentaje",
        {
            "tasa_corto_plazo": active & (F.col("plazo") == SHORT),
            "tasa_largo_plazo": active & (F.col("plazo") == LONG),
        },
    )


def term_rates_with_interbank(t: Tables, keys: Keys = ()) -> DataFrame:
    """Active rates beside the interbank rate of the same month and currency."""
    on = [*keys, "fecha", "moneda"]
    interbank = t["tasa_interbancaria"].select(*on, F.col("tasa").alias("tasa_interbancaria"))
    return active_terms(t, keys).join(interbank, on)


def bank_spread(t: Tables, keys: Keys = ()) -> DataFrame:
    """Active rates less the interbank rate."""
    return term_rates_with_interbank(t, keys).select(
        *keys,
        "fecha",
        "moneda",
        (F.col("tasa_corto_plazo") - F.col("tasa_interbancaria")).alias("spread_cp"),
        (F.col("tasa_largo_plazo") - F.col("tasa_interbancaria")).alias("spread_lp"),
    )


def bank_spread_history(t: Tables, keys: Keys = ()) -> DataFrame:
    """Bank spread with the short spread of the row before in the same currency."""
    return previous_value(
        bank_spread(t, keys), {"spread_cp": "ultimo_spread_cp"}, lag=1, keys=[*keys, "moneda"]
    )


def us_inflation(t: Tables, keys: Keys = (), mode: str = "calendar") -> DataFrame:
    """Year-on-year inflation of the foreign price index against the same month a year before.

    Months whose comparison month is missing are absent, not compared with another month.
    ``mode='row'`` compares with twelve rows before instead.
    """
    seen = t["cpi_usa"].select(*keys, "fecha", "cpi_usa").filter(F.col("cpi_usa").isNotNull())
    paired = previous_value(seen, {"cpi_usa": "cpi_usa_anio_anterior"}, 12, mode, keys=keys)
    now, before = F.col("cpi_usa").cast("double"), F.col("cpi_usa_anio_anterior").cast("double")
    return paired.filter(F.col("cpi_usa_anio_anterior").isNotNull()).withColumn(
        "inflacion_interanual_usa", ratio(now - before, before) * 100
    )


def _us_rate(t: Tables, keys: Keys) -> DataFrame:
    return us_inflation(t, keys).select(*keys, "fecha", "inflacion_interanual_usa")


def real_lending_rate(t: Tables, keys: Keys = ()) -> DataFrame:
    """Active rates less inflation: local for MN, foreign for ME; NULL without a deflator."""
    on = [*keys, "fecha"]
    deflated = spine_join(
        active_terms(t, keys),
        [
            (t["ipc"], ["inflacion_interanual"]),
            (_us_rate(t, keys), ["inflacion_interanual_usa"]),
        ],
        on,
    )
    deflator = F.when(F.col("moneda") == LOCAL, F.col("inflacion_interanual")).when(
        F.col("moneda") == FOREIGN, F.col("inflacion_interanual_usa")
    )
    return deflated.select(
        *on,
        "moneda",
        (F.col("tasa_corto_plazo") - deflator).alias("tasa_real_col_cp"),
        (F.col("tasa_largo_plazo") - deflator).alias("tasa_real_col_lp"),
    )


def real_financial_growth(t: Tables, keys: Keys = ()) -> DataFrame:
    """Monthly growth of activity and credit beside the bank spread, one row per currency.

    Growth is against the row before among months that have both series.
    """
    on = [*keys, "fecha"]
    both = t["credito"].select(*on, "credito").join(t["imae"].select(*on, "imae"), on)
    growth = period_change(
        both, {"imae": "var_men_imae", "credito": "var_men_credito"}, lag=1, keys=keys
    ).filter(F.col("var_men_imae").isNotNull() & F.col("var_men_credito").isNotNull())
    return growth.join(bank_spread(t, keys), on).select(
        *on, "moneda", "var_men_imae", "var_men_credito", "spread_cp", "spread_lp"
    )


def yearly_crawl(t: Tables, keys: Keys = ()) -> DataFrame:
    """Inflation and exchange rate of the months that have both, with the rate's yearly change."""
    on = [*keys, "fecha"]
    both = t["ipc"].select(*on, "inflacion_interanual").join(t["tc"].select(*on, "tc"), on)
    return period_change(both, {"tc": "deslizamiento_anual"}, keys=keys)


def crawl_gap(t: Tables, keys: Keys = ()) -> DataFrame:
    """Inflation less the yearly crawl of the exchange rate, with the anchor state.

    The first twelve months have no crawl; the next has no previous crawl, so it is absent too.
    """
    return gap_of_crawl(yearly_crawl(t, keys), keys)


def gap_of_crawl(yearly: DataFrame, keys: Keys = ()) -> DataFrame:
    """``crawl_gap`` from the yearly crawl."""
    on = [*keys, "fecha"]
    crawl = yearly.filter(F.col("deslizamiento_anual").isNotNull())
    gap = (
        previous_value(crawl, {"deslizamiento_anual": "deslizamiento_previo"}, lag=1, keys=keys)
        .filter(F.col("deslizamiento_previo").isNotNull())
        .withColumn(
            "brecha_deslizamiento", F.col("inflacion_interanual") - F.col("deslizamiento_anual")
        )
    )
    size = F.col("brecha_deslizamiento")
    state, _ = classify(
        [
            State(ANCHOR_GOOD, 1, size <= ANCHOR_GOOD_LIMIT),
            State(ANCHOR_IMPORTED, 2, size <= ANCHOR_IMPORTED_LIMIT),
            State(ANCHOR_SHOCK, 3, size > ANCHOR_IMPORTED_LIMIT),
        ]
    )
    return gap.select(
        *on,
        "inflacion_interanual",
        "deslizamiento_anual",
        "deslizamiento_previo",
        "brecha_deslizamiento",
        state.alias("estado_anclaje_cambiario"),
    )


def term_curve(t: Tables, keys: Keys = ()) -> DataFrame:
    """Long less short rate per currency, its previous value and the shape of the curve.

    Rates of a term are summed over every rate kind.
    """
    terms = conditional_pivot(
        t["tasas_interes"],
        [*keys, "fecha", "moneda"],
        "tasa_porcentaje",
        {"_short": F.col("plazo") == SHORT, "_long": F.col("plazo") == LONG},
        how="sum",
    ).withColumn("spread_plazos", F.col("_long") - F.col("_short"))
    spread = F.col("spread_plazos")
    state, _ = classify(
        [
            State(CURVE_NORMAL, 1, spread > 0),
            State(CURVE_FLAT, 2, spread == 0),
            State(CURVE_INVERTED, 3, spread < 0),
        ]
    )
    history = previous_value(
        terms, {"spread_plazos": "spread_mes_anterior"}, lag=1, keys=[*keys, "moneda"]
    )
    return history.filter(F.col("spread_mes_anterior").isNotNull()).select(
        *keys, "fecha", "moneda", "spread_plazos", "spread_mes_anterior", state.alias("estado_spread")
    )


def external_exposure(t: Tables, keys: Keys = ()) -> DataFrame:
    """Money beyond M2A as a share of M3A, as a ratio and in percent, four decimals each.

    The amount column is the difference M3A - M2A, whatever deposits it is made of.
    """
    m2a, m3a = F.col("m2a"), F.col("m3a")
    return (
        t["bm"]
        .select(*keys, "fecha", "m2a", "m3a")
        .filter(m3a.isNotNull() & m2a.isNotNull())
        .withColumns(
            {
                "depositos_no_residentes": m3a - m2a,
                "ratio_exposicion_externa": ratio(m3a - m2a, m3a).cast("decimal(18,4)"),
                "ratio_exposicion_externa_pct": ratio((m3a - m2a) * 100, m3a).cast("decimal(18,4)"),
            }
        )
    )


def public_sector_weight(t: Tables, keys: Keys = (), rounded: bool = False) -> DataFrame:
    """Public-sector liquidity (M2A - M2) as a share of M3A, and yearly growth beside credit.

    Months without M2A or M2 are left out before looking twelve rows back. ``rounded`` is the
    stored form of the view: they stay in, and the share's numerator has six decimals.
    """
    on = [*keys, "fecha"]
    liquidity = F.col("m2a") - F.col("m2")
    money = t["bm"].select(*on, "m2", "m2a", "m3a")
    if rounded:
        numerator = liquidity.cast("decimal(38,6)")
    else:
        money = money.filter(F.col("m2a").isNotNull() & F.col("m2").isNotNull())
        numerator = liquidity
    base = (
        money.join(t["credito"].select(*on, "credito"), on)
        .withColumns(
            {
                "liquidez_spnf": liquidity,
                "peso_estado": ratio(numerator.cast("double"), F.col("m3a").cast("double")),
            }
        )
    )
    growth = previous_value(
        base, {"liquidez_spnf": "_liquidity_before", "credito": "_credit_before"}, 12, keys=keys
    ).withColumns(
        {
            "var_inter_credito": _growth("credito", "_credit_before"),
            "var_inter_spnf": _growth("liquidez_spnf", "_liquidity_before"),
        }
    )
    needed = (
        ("var_inter_credito", "var_inter_spnf")
        if rounded
        else ("_liquidity_before", "_credit_before")
    )
    return growth.filter(F.col(needed[0]).isNotNull() & F.col(needed[1]).isNotNull()).select(
        *on, "peso_estado", "var_inter_credito", "var_inter_spnf"
    )


def _growth(now: str, before: str) -> Column:
    current, earlier = F.col(now).cast("double"), F.col(before).cast("double")
    return ratio(current - earlier, earlier) * 100


def reserve_coverage(t: Tables, keys: Keys = ()) -> DataFrame:
    """Reserves in local currency (six decimals) over each monetary aggregate, with yearly change."""
    on = [*keys, "fecha"]
    reserves = (
        t["rin"].select(*on, "rin").join(t["tc"].select(*on, "tc"), on)
        .select(*on, (F.col("rin") * F.col("tc")).cast("decimal(18,6)").alias("_reserves"))
    )
    names = {
        aggregate: f"cobertura_rin_{'bm' if aggregate == 'base_monetaria' else aggregate}"
        for aggregate in AGGREGATES
    }
    covered = reserves.join(t["bm"].select(*on, *AGGREGATES), on).select(
        *on,
        *[
            ratio(F.col("_reserves").cast("double"), F.col(a).cast("double")).alias(name)
            for a, name in names.items()
        ],
    )
    changed = period_change(covered, {n: f"var_int_{n}" for n in names.values()}, keys=keys)
    return changed.filter(F.col("var_int_cobertura_rin_m1").isNotNull()).select(
        *on, *[column for n in names.values() for column in (n, f"var_int_{n}")]
    )


def rate_parity(t: Tables, keys: Keys = ()) -> DataFrame:
    """Real rates in local and foreign currency and their difference, by rate kind and term."""
    on = [*keys, "fecha"]
    sides = conditional_pivot(
        t["tasas_interes"],
        [*on, "tipo_tasa", "plazo"],
        "tasa_porcentaje",
        {"_local": F.col("moneda") == LOCAL, "_foreign": F.col("moneda") == FOREIGN},
    )
    stored = "inflacion_calculada" in t["ipc"].columns
    prices = t["ipc"] if stored else computed_inflation(t, keys)
    local_rate = prices.select(*on, "inflacion_calculada")
    real = sides.join(local_rate, on).join(_us_rate(t, keys), on).withColumns(
        {
            "tasa_real_mn": F.col("_local") - F.col("inflacion_calculada"),
            "tasa_real_me": F.col("_foreign") - F.col("inflacion_interanual_usa"),
        }
    )
    return real.filter(
        F.col("tasa_real_mn").isNotNull() & F.col("tasa_real_me").isNotNull()
    ).select(
        *on,
        "tipo_tasa",
        "plazo",
        "tasa_real_mn",
        "tasa_real_me",
        (F.col("tasa_real_mn") - F.col("tasa_real_me")).alias("spread_paridad_tasas"),
    )


def real_exchange_rate(t: Tables, base: str = "2011-01-01", keys: Keys = ()) -> DataFrame:
    """Exchange rate times foreign over local prices, both rebased to the month ``base``.

    Empty when the base month is missing from either index.
    """
    on = [*keys, "fecha"]
    joined = (
        t["tc"].select(*on, "tc")
        .join(t["ipc"].select(*on, "ipc"), on)
        .join(t["cpi_usa"].select(*on, "cpi_usa"), on)
    )
    at_base = F.col("fecha") == F.lit(base).cast("date")
    for name in ("ipc", "cpi_usa"):
        joined = attach_constant(
            joined, t[name], {f"_base_{name}": F.max(F.when(at_base, F.col(name)))}, keys
        )
    local = F.col("ipc").cast("double") / F.col("_base_ipc").cast("double")
    foreign = F.col("cpi_usa").cast("double") / F.col("_base_cpi_usa").cast("double")
    return joined.select(
        *on,
        "tc",
        (local * 100).alias("ipc_nic_base2011"),
        (foreign * 100).alias("cpi_usa_base2011"),
        (F.col("tc") * foreign / local).alias("tcr"),
    )


def yearly_inflation(t: Tables, peak_year: int = 2022, keys: Keys = ()) -> DataFrame:
    """Mean inflation per year and its distance from the mean of the peak year."""
    yearly = t["ipc"].groupBy(*keys, F.year("fecha").alias("anio")).agg(
        F.avg("inflacion_interanual").alias("inflacion_promedio")
    )
    peak = F.max(F.when(F.col("anio") == peak_year, F.col("inflacion_promedio")))
    return attach_constant(yearly, yearly, {"_peak": peak}, keys, required=False).select(
        *keys,
        "anio",
        "inflacion_promedio",
        (F.col("inflacion_promedio") - F.col("_peak")).alias("gap_pico"),
    )


def policy_transmission(t: Tables, rows: int | None = None, keys: Keys = ()) -> DataFrame:
    """Interbank less reference rate and whether policy passes through.

    A month without a gap counts as a deviation. ``rows`` keeps the newest rows of each key, or
    of the one series without keys.
    """
    on = [*keys, "fecha"]
    reference = t["trm"].select(*on, "trm").filter(F.col("trm").isNotNull())
    gap = reference.join(t["tasa_interbancaria"].select(*on, "moneda", "tasa"), on).withColumn(
        "gap_transmision", F.col("tasa") - F.col("trm")
    )
    state, _ = classify(
        [State(POLICY_PASSED, 1, F.col("gap_transmision") <= POLICY_PASSED_LIMIT)],
        otherwise=(POLICY_MISSED, 2),
    )
    history = (
        previous_value(gap, {"trm": "trm_mes_anterior"}, lag=1, keys=[*keys, "moneda"])
        .filter(F.col("trm_mes_anterior").isNotNull())
        .select(
            *on, "moneda", "gap_transmision", "trm_mes_anterior", state.alias("estado_efectividad")
        )
    )
    if rows is None:
        return history
    if not keys:
        return latest(history, rows, ties=["moneda"])
    newest = Window.partitionBy(*keys).orderBy(F.col("fecha").desc(), "moneda")
    return history.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= rows).drop("_n")


def computed_inflation(t: Tables, keys: Keys = ()) -> DataFrame:
    """Price index with inflation computed from it, the official figure where that is impossible."""
    changed = period_change(t["ipc"].drop("inflacion_calculada"), {"ipc": "_computed"}, keys=keys)
    return changed.withColumn(
        "inflacion_calculada",
        F.coalesce("_computed", "inflacion_interanual").cast("decimal(18,6)"),
    ).drop("_computed")


def yearly_change(t: Tables, table: str, column: str, into: str, keys: Keys = ()) -> DataFrame:
    """A base table with the change of one column against twelve rows before; NULLs kept."""
    return period_change(t[table], {column: into}, keys=keys)


def relative_inflation_gap(t: Tables, keys: Keys = ()) -> DataFrame:
    """Inflation less the sum of crawl and foreign inflation."""
    gap = crawl_gap(t, keys).select(
        *keys, "fecha", "inflacion_interanual", "deslizamiento_anual", "brecha_deslizamiento"
    )
    return gap.join(_us_rate(t, keys), [*keys, "fecha"]).select(
        *keys,
        "fecha",
        F.col("inflacion_interanual").alias("inflacion_nic"),
        "deslizamiento_anual",
        "brecha_deslizamiento",
        F.col("inflacion_interanual_usa").alias("inflacion_usa"),
        (
            F.col("inflacion_interanual")
            - (F.col("deslizamiento_anual") + F.col("inflacion_interanual_usa"))
        ).alias("brecha_inflacion_relativa"),
    )


def reserves_local_currency(
    t: Tables, kind: str = "decimal(14,6)", keys: Keys = ()
) -> DataFrame:
    """Reserves table with its local-currency column set where the exchange rate is known."""
    rin = t["rin"]
    if "rin_nio" not in rin.columns:
        rin = rin.withColumn("rin_nio", F.lit(None).cast(kind))
    value = (F.col("rin") * F.col("new_tc")).cast(kind)
    return update_from(rin, t["tc"], [*keys, "fecha"], {"rin_nio": value}, ["tc"])


def override(table: DataFrame, patch: DataFrame, column: str, keys: Keys = ("fecha",)) -> DataFrame:
    """Table with one column replaced by hand-made values on the patch's dates."""
    return update_from(table, patch, keys, {column: F.col(f"new_{column}")}, [column])


def money_differences(t: Tables, since: str, keys: Keys = ()) -> DataFrame:
    """Recent months of the aggregates and the public-sector differences, to look for NULLs."""
    recent = F.col("fecha") >= F.lit(since).cast("date")
    return t["bm"].filter(recent).select(
        *keys,
        "fecha",
        *AGGREGATES,
        (F.col("m2a") - F.col("m2")).alias("spnf_m2"),
        (F.col("m3a") - F.col("m3")).alias("spnf_m3"),
    )


def zero_values(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is exactly zero, newest first.

    The other columns break ties, so the sort can cut a date that holds most of the rows.
    """
    others = [name for name in df.columns if name != "fecha"]
    return df.filter(F.col(column) == 0).orderBy(F.col("fecha").desc(), *others)


def real_lending_rate_of_year(t: Tables, year: int, keys: Keys = ()) -> DataFrame:
    """Real lending rates of one year under the month's Spanish name.

    The year is a date range, so partitioned or sorted base tables are pruned by it.
    """
    first, last = (F.lit(f"{year}-{end}").cast("date") for end in ("01-01", "12-31"))
    return real_lending_rate(t, keys).filter(F.col("fecha").between(first, last)).select(
        *keys,
        month_name(F.col("fecha")).alias("mes_texto"),
        "moneda",
        "tasa_real_col_cp",
        "tasa_real_col_lp",
    )


def rates_with_interbank_listing(t: Tables, keys: Keys = ()) -> DataFrame:
    """Active rates with every interbank rate of their month, one row per interbank currency."""
    on = [*keys, "fecha"]
    interbank = t["tasa_interbancaria"].select(
        *on, F.col("moneda").alias("moneda_interbancaria"), F.col("tasa").alias("tasa_interbancaria")
    )
    active = t["tasas_interes"].filter(F.col("tipo_tasa") == ACTIVE)
    return active.select(*on, "moneda", "plazo", F.col("tasa_porcentaje").alias("tasa")).join(
        interbank, on, "left"
    )


def reference_with_interbank(t: Tables, keys: Keys = ()) -> DataFrame:
    """Reference rate with every interbank rate of its month."""
    on = [*keys, "fecha"]
    return t["trm"].select(*on, "trm").join(
        t["tasa_interbancaria"].select(*on, "moneda", "tasa"), on
    )
