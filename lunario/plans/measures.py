"""Measures over the views: last-known figures, zones, states, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lunario.functions.numbers import ratio
from lunario.functions.states import State, classify
from lunario.operators.change import period_change
from lunario.operators.profile import last_non_blank
from lunario.operators.shape import attach_constant, conditional_pivot
from lunario.plans import views
from lunario.plans.views import Keys, Tables

# Alert weight of the public sector.
WEIGHT_ALERT = 0.20

# Growth and inflation limits (as fractions) and the four macro states.
GROWTH_LIMIT = 0.035
INFLATION_LIMIT = 0.03
MACRO_ANCHORED = "Expansión con anclaje"
MACRO_PRESSURED = "Expansión con presión"
MACRO_CONTROLLED = "Desaceleración controlada"
MACRO_STAGFLATION = "Estanflación"
MACRO_UNKNOWN = "Sin datos"

# Limits of the loan-to-deposit zones and their names.
LDR_LOW = 0.75
LDR_HIGH = 0.85
LDR_IDLE = "Subutilización"
LDR_EFFICIENT = "Zona eficiente"
LDR_PRESSURE = "Presión de liquidez"

# Inflation target band, in percent.
TARGET_LOW = 2
TARGET_HIGH = 3


def kpi(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Last-known value of a series; a time series when ``fecha`` is among the keys."""
    return last_non_blank(df, value, "fecha", keys)


def latest_figures(
    figures: Sequence[tuple[str, DataFrame, str, Column | None]], label: str, keys: Keys = ()
) -> DataFrame:
    """Last-known value of several series in one aggregate: label, keys, currency, date, value.

    Each figure is a name, a table, its value column and its currency column, if it has one. The
    tables are laid end to end, and one hash aggregate that combines map side takes the newest value
    of each figure, so the number of shuffles does not grow with the figures.
    """
    rows = [
        df.filter(F.col(value).isNotNull()).select(
            F.lit(name).alias(label),
            *keys,
            (F.lit(None).cast("string") if currency is None else currency).alias("moneda"),
            "fecha",
            F.col(value).cast("double").alias("valor"),
        )
        for name, df, value, currency in figures
    ]
    return (
        reduce(DataFrame.unionByName, rows)
        .groupBy(label, *keys, "moneda")
        .agg(F.max_by("valor", "fecha").alias("valor"), F.max("fecha").alias("fecha"))
        .select(label, *keys, "moneda", "fecha", "valor")
    )


def named_kpis(t: Tables, base: str = "2011-01-01", keys: Keys = ()) -> DataFrame:
    """Every headline figure in one table: name, currency, date, value.

    The bank spreads have one row for each currency; the other figures have none.
    """
    spread, currency = views.bank_spread(t, keys), F.col("moneda")
    growth = views.yearly_change(t, "imae", "imae", "v", keys)
    return latest_figures(
        [
            ("KPI_IMAE_Var_Int", growth, "v", None),
            ("KPI_Inflacion_Interanual", t["ipc"], "inflacion_interanual", None),
            ("KPI_TC_Actual", t["tc"], "tc", None),
            ("KPI_RIN_Actual", t["rin"], "rin", None),
            ("KPI_Credito_Actual", t["credito"], "credito", None),
            ("KPI_TCR_Actual", views.real_exchange_rate(t, base, keys), "tcr", None),
            ("KPI_Spread_CP", spread, "spread_cp", currency),
            ("KPI_Spread_LP", spread, "spread_lp", currency),
            ("KPI_LDR_Actual", loan_to_deposit(t, keys=keys), "ldr", None),
        ],
        "kpi",
        keys,
    )


def weight_buffer(t: Tables, ceiling: float = WEIGHT_ALERT, keys: Keys = ()) -> DataFrame:
    """Room left between the public-sector weight and its alert level."""
    weight = views.public_sector_weight(t, keys).select(*keys, "fecha", "peso_estado")
    return weight.withColumn("crowding_buffer", ceiling - F.col("peso_estado"))


def macro_state(growth: Column, inflation: Column) -> tuple[Column, Column]:
    """Text and code of the macro state from growth and inflation as fractions.

    Missing input gives the unknown state with code 0.
    """
    fast, anchored = growth >= GROWTH_LIMIT, inflation <= INFLATION_LIMIT
    return classify(
        [
            State(MACRO_ANCHORED, 1, fast & anchored),
            State(MACRO_PRESSURED, 2, fast & ~anchored),
            State(MACRO_CONTROLLED, 3, ~fast & anchored),
            State(MACRO_STAGFLATION, 4, ~fast & ~anchored),
        ],
        otherwise=(MACRO_UNKNOWN, 0),
    )


def macro_states(t: Tables, keys: Keys = ()) -> DataFrame:
    """Macro state of every month of the price index."""
    on = [*keys, "fecha"]
    growth = views.yearly_change(t, "imae", "imae", "_growth", keys).select(*on, "_growth")
    both = t["ipc"].select(*on, "inflacion_interanual").join(growth, on, "left")
    fractions = to_fractions(
        both.select(
            *on,
            F.col("_growth").alias("imae_var_int"),
            F.col("inflacion_interanual").alias("inflacion"),
        ),
        ["imae_var_int", "inflacion"],
    )
    text, code = macro_state(F.col("imae_var_int"), F.col("inflacion"))
    return fractions.withColumns({"estado_macro_actual": text, "estado_macro_valor": code})


def purchasing_power_gap(t: Tables, tolerance: float = 0.0, keys: Keys = ()) -> DataFrame:
    """Domestic price pressure with its state pair; within ``tolerance`` of zero is balance."""
    gap = views.relative_inflation_gap(t, keys).select(
        *keys, "fecha", F.col("brecha_inflacion_relativa").alias("brecha_ppa")
    )
    size = F.col("brecha_ppa")
    text, code = classify(
        [
            State("Presión inflacionaria", 1, size > tolerance),
            State("Equilibrio", 2, size >= -tolerance),
            State("Presión deflacionaria", 3, size < -tolerance),
        ],
        otherwise=(MACRO_UNKNOWN, 0),
    )
    return gap.withColumns({"estado_anclaje_ppa_texto": text, "estado_anclaje_ppa_valor": code})


def loan_to_deposit(t: Tables, factor: float = 1.0, keys: Keys = ()) -> DataFrame:
    """Credit over M3A (times ``factor``, for tables in different units)."""
    on = [*keys, "fecha"]
    both = t["credito"].select(*on, "credito").join(t["bm"].select(*on, "m3a"), on)
    credit = F.lit(factor) * F.col("credito").cast("double")
    return both.select(*on, ratio(credit, F.col("m3a").cast("double")).alias("ldr"))


def loan_to_deposit_zones(t: Tables, factor: float = 1.0, keys: Keys = ()) -> DataFrame:
    """Loan-to-deposit ratio with its zone, as text and code; both limits are efficient."""
    level = F.col("ldr")
    text, code = classify(
        [
            State(LDR_IDLE, 1, level < LDR_LOW),
            State(LDR_EFFICIENT, 2, level <= LDR_HIGH),
            State(LDR_PRESSURE, 3, level > LDR_HIGH),
        ],
        otherwise=(MACRO_UNKNOWN, 0),
    )
    return loan_to_deposit(t, factor, keys).withColumns(
        {"estado_ldr_texto": text, "estado_ldr_valor": code}
    )


def centred_loan_to_deposit(t: Tables, factor: float = 1.0, keys: Keys = ()) -> DataFrame:
    """Loan-to-deposit ratio as the distance from the lower efficient limit."""
    return loan_to_deposit(t, factor, keys).withColumn("ldr_centrado", F.col("ldr") - LDR_LOW)


def real_rate_reference(t: Tables, base: str = "2011-01-01", keys: Keys = ()) -> DataFrame:
    """Real exchange rate with the mean of its whole history on every row."""
    rate = views.real_exchange_rate(t, base, keys).select(*keys, "fecha", "tcr")
    return attach_constant(
        rate, rate, {"ref_promedio_tcr": F.avg("tcr")}, keys, required=False
    )


def real_rate_status(
    t: Tables, base: str = "2011-01-01", threshold: float = 0.05, keys: Keys = ()
) -> DataFrame:
    """Real exchange rate against its own mean; beyond ``threshold`` is a deviation."""
    off = ratio(F.col("tcr"), F.col("ref_promedio_tcr")) - 1
    text, _ = classify(
        [
            State("Por encima del promedio", 1, F.col("desviacion") > threshold),
            State("En línea con el promedio", 2, F.col("desviacion") >= -threshold),
            State("Por debajo del promedio", 3, F.col("desviacion") < -threshold),
        ]
    )
    return (
        real_rate_reference(t, base, keys)
        .withColumn("desviacion", off)
        .withColumn("indicador_status_tcr", text)
    )


def growth_credit_correlation(t: Tables, keys: Keys = ()) -> DataFrame:
    """Pearson correlation of activity and credit growth, month on month and year on year."""
    on = [*keys, "fecha"]
    both = t["imae"].select(*on, "imae").join(t["credito"].select(*on, "credito"), on)
    grown = both
    for lag, suffix in ((1, "mensual"), (12, "interanual")):
        grown = period_change(
            grown, {"imae": f"_imae_{suffix}", "credito": f"_credito_{suffix}"}, lag, keys=keys
        )
    return grown.groupBy(*keys).agg(
        *[
            F.corr(f"_imae_{suffix}", f"_credito_{suffix}").alias(f"correlacion_{suffix}")
            for suffix in ("mensual", "interanual")
        ]
    )


def weight_summary(t: Tables, ceiling: float = WEIGHT_ALERT, keys: Keys = ()) -> DataFrame:
    """Highest and latest public-sector weight, and the number of months above the alert level."""
    weight = F.col("peso_estado")
    known = F.when(weight.isNotNull(), F.col("fecha"))
    return (
        views.public_sector_weight(t, keys)
        .groupBy(*keys)
        .agg(
            F.max(weight).alias("peso_maximo"),
            F.max(known).alias("fecha_actual"),
            F.max_by(weight, known).alias("peso_actual"),
            F.count_if(weight > ceiling).alias("meses_en_alerta"),
        )
    )


def money_growth(t: Tables, keys: Keys = ()) -> DataFrame:
    """Yearly growth of base money, M2 and reserves; every month that either table has."""
    on = [*keys, "fecha"]
    money = period_change(
        t["bm"].select(*on, "base_monetaria", "m2"),
        {"base_monetaria": "var_int_bm", "m2": "var_int_m2"},
        keys=keys,
    )
    reserves = period_change(t["rin"].select(*on, "rin"), {"rin": "var_int_rin"}, keys=keys)
    return money.join(reserves, on, "full_outer").select(
        *on, "var_int_bm", "var_int_m2", "var_int_rin"
    )


def inflation_zones(t: Tables, keys: Keys = ()) -> DataFrame:
    """Activity zone, and local and foreign inflation side by side with their target-band flags."""
    on = [*keys, "fecha"]
    growth = views.yearly_change(t, "imae", "imae", "imae_var_int", keys)
    joined = (
        t["ipc"].select(*on, "inflacion_interanual")
        .join(growth.select(*on, "imae_var_int"), on, "left")
        .join(views.us_inflation(t, keys).select(*on, "inflacion_interanual_usa"), on, "left")
    )
    zone, _ = classify(
        [
            State("Expansión", 1, F.col("imae_var_int") >= GROWTH_LIMIT * 100),
            State("Contracción", 2, F.col("imae_var_int") < GROWTH_LIMIT * 100),
        ],
        otherwise=(MACRO_UNKNOWN, 0),
    )
    return joined.select(
        *on,
        "imae_var_int",
        zone.alias("zona_imae"),
        "inflacion_interanual",
        F.col("inflacion_interanual").between(TARGET_LOW, TARGET_HIGH).alias("en_meta"),
        "inflacion_interanual_usa",
        F.col("inflacion_interanual_usa").between(TARGET_LOW, TARGET_HIGH).alias("en_meta_usa"),
    )


def to_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent-point columns (4.06 for 4.06 %) as fractions."""
    return df.withColumns({name: F.col(name).cast("double") / 100 for name in columns})


def term_premium(t: Tables, keys: Keys = ()) -> DataFrame:
    """Long bank spread in local over foreign currency, month by month."""
    sides = conditional_pivot(
        views.bank_spread(t, keys),
        [*keys, "fecha"],
        "spread_lp",
        {
            "spread_lp_mn": F.col("moneda") == views.LOCAL,
            "spread_lp_me": F.col("moneda") == views.FOREIGN,
        },
    )
    return sides.withColumn("prima_plazo", ratio(F.col("spread_lp_mn"), F.col("spread_lp_me")))


def external_risk(t: Tables, keys: Keys = ()) -> DataFrame:
    """Latest external exposure and reserve coverage, one row per measure."""
    coverage = views.reserve_coverage(t, keys)
    exposure = views.external_exposure(t, keys)
    return latest_figures(
        [
            ("exposicion_externa_pct", exposure, "ratio_exposicion_externa_pct", None),
            ("cobertura_rin_m1", coverage, "cobertura_rin_m1", None),
            ("cobertura_rin_m2", coverage, "cobertura_rin_m2", None),
            ("cobertura_rin_m2a", coverage, "cobertura_rin_m2a", None),
        ],
        "medida",
        keys,
    ).drop("moneda")
