from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from lunario.plans import catalog, measures, views
from lunario.workload.derive import base_tables

SF_DIR = "/root/testdata/sf0.001"


def months(first_year: int, count: int) -> list[date]:
    return [date(first_year + i // 12, i % 12 + 1, 1) for i in range(count)]


def column(spark, name, days, values, kind="double"):
    return spark.createDataFrame(list(zip(days, values, strict=True)), f"fecha date, {name} {kind}")


@pytest.fixture(scope="module")
def national(spark):
    return base_tables(
        spark, SF_DIR, "ipc", "cpi_usa", "imae", "tc", "trm", "tasa_interbancaria",
        "tasas_interes", "credito", "rin", "bm",
    )


def copies(df, names=("x", "y")):
    """The same series under several keys."""
    return df.withColumn("pais", F.explode(F.array(*[F.lit(name) for name in names])))


def plain(row):
    """Row with floats at the precision sums in another order keep."""
    return tuple(f"{value:.9g}" if isinstance(value, float) else str(value) for value in row)


@pytest.mark.parametrize(
    "view, needed",
    [
        (views.macro_panel, "ipc bm credito imae rin tc trm"),
        (views.bank_spread, "tasas_interes tasa_interbancaria"),
        (views.us_inflation, "cpi_usa"),
        (views.real_lending_rate, "tasas_interes ipc cpi_usa"),
        (views.real_financial_growth, "credito imae tasas_interes tasa_interbancaria"),
        (views.crawl_gap, "ipc tc"),
        (views.term_curve, "tasas_interes"),
        (views.external_exposure, "bm"),
        (views.public_sector_weight, "bm credito"),
        (views.reserve_coverage, "rin tc bm"),
        (views.rate_parity, "tasas_interes ipc cpi_usa"),
        (lambda t, keys=(): views.real_exchange_rate(t, "1995-01-01", keys), "tc ipc cpi_usa"),
        (lambda t, keys=(): views.yearly_inflation(t, 1998, keys), "ipc"),
        (lambda t, keys=(): measures.real_rate_status(t, "1995-01-01", keys=keys), "tc ipc cpi_usa"),
        (measures.growth_credit_correlation, "imae credito"),
        (measures.weight_summary, "bm credito"),
        (views.policy_transmission, "trm tasa_interbancaria"),
        (measures.external_risk, "bm rin tc"),
        (measures.money_growth, "bm rin"),
        (
            lambda t, keys=(): measures.named_kpis(t, "1995-01-01", keys),
            "ipc cpi_usa imae tc tasas_interes tasa_interbancaria credito rin bm",
        ),
    ],
)
def test_series_keys_repeat_the_single_series(spark, national, tmp_path, view, needed):
    stored = {}
    for name in needed.split():
        path = str(tmp_path / name)
        national[name].write.parquet(path)
        stored[name] = spark.read.parquet(path)
    single = {plain(row) for row in view(stored).collect()}
    keyed = {name: copies(df) for name, df in stored.items()}
    result = view(keyed, keys=["pais"])
    for pais in ("x", "y"):
        rows = result.filter(F.col("pais") == pais).drop("pais").collect()
        assert {plain(row) for row in rows} == single


def test_foreign_inflation_survives_gaps(spark):
    days = months(2021, 36)
    values = [100.0 + i for i in range(36)]
    whole = views.us_inflation({"cpi_usa": column(spark, "cpi_usa", days, values)})
    kept = [i for i in range(36) if i not in (9, 10)]
    gapped = views.us_inflation(
        {"cpi_usa": column(spark, "cpi_usa", [days[i] for i in kept], [values[i] for i in kept])}
    )
    full = {r.fecha: r.inflacion_interanual_usa for r in whole.collect()}
    seen = {r.fecha: r.inflacion_interanual_usa for r in gapped.collect()}
    assert seen == {d: v for d, v in full.items() if d not in (days[21], days[22])}


def test_anchor_states_at_their_limits(spark):
    days = months(2020, 18)
    gaps = [None] * 13 + [1.5, 1.51, 4.0, 4.01, 0.0]
    t = {
        "ipc": column(spark, "inflacion_interanual", days, gaps),
        "tc": column(spark, "tc", days, [10.0] * 18),
    }
    states = [r.estado_anclaje_cambiario for r in views.crawl_gap(t).orderBy("fecha").collect()]
    assert states == [
        None,
        "Anclaje Exitoso",
        "Presión por Costos Importados",
        "Presión por Costos Importados",
        "Desalineamiento / Shock Estructural",
        "Anclaje Exitoso",
    ][1:]


def test_policy_gap_limit_and_missing_rate(spark):
    days = months(2024, 3)
    t = {
        "trm": column(spark, "trm", days, [5.0, 5.0, 5.0]),
        "tasa_interbancaria": spark.createDataFrame(
            [(days[0], "MN", 5.0), (days[1], "MN", 5.5), (days[2], "MN", None)],
            "fecha date, moneda string, tasa double",
        ),
    }
    rows = views.policy_transmission(t).orderBy("fecha").collect()
    assert [r.estado_efectividad for r in rows] == ["Transmisión Efectiva", "Desvío de Política"]


def test_policy_rows_are_counted_for_each_key(spark, national):
    t = {n: copies(national[n], ("x", "y", "z")) for n in ("trm", "tasa_interbancaria")}
    whole = views.policy_transmission(t, keys=["pais"]).count()
    assert whole == 3 * views.policy_transmission(national).count()
    newest = views.policy_transmission(t, rows=10, keys=["pais"])
    assert {tuple(r) for r in newest.groupBy("pais").count().collect()} == {
        ("x", 10), ("y", 10), ("z", 10)
    }


def test_money_growth_keeps_months_of_either_table(spark):
    days = months(2024, 3)
    bm = column(spark, "m2", days[:2], [1.0, 2.0]).withColumn("base_monetaria", F.col("m2"))
    grown = measures.money_growth({"bm": bm, "rin": column(spark, "rin", days[1:], [1.0, 2.0])})
    assert sorted(r.fecha for r in grown.collect()) == days


def test_weight_forms_differ_only_by_their_filter(spark):
    days = months(2020, 27)
    m2 = [100.0 + i for i in range(27)]
    m2a = [None if i == 3 else 110.0 + 2 * i for i in range(27)]
    bm = spark.createDataFrame(
        [(d, a, b, 200.0) for d, a, b in zip(days, m2, m2a, strict=True)],
        "fecha date, m2 double, m2a double, m3a double",
    )
    t = {"bm": bm, "credito": column(spark, "credito", days, [50.0 + i for i in range(27)])}
    filtered = {r.fecha for r in views.public_sector_weight(t).collect()}
    stored = {r.fecha for r in views.public_sector_weight(t, rounded=True).collect()}
    assert filtered == set(days[13:])
    assert stored == {d for d in days[12:] if d != days[15]}


def test_exposure_skips_missing_and_zero(spark):
    bm = spark.createDataFrame(
        [(1, "80", "100"), (2, None, "100"), (3, "80", None), (4, "80", "0")],
        "m int, m2a string, m3a string",
    ).select(
        F.make_date(F.lit(2024), "m", F.lit(1)).alias("fecha"),
        F.col("m2a").cast("decimal(18,4)"),
        F.col("m3a").cast("decimal(18,4)"),
    )
    rows = views.external_exposure({"bm": bm}).orderBy("fecha").collect()
    assert [(r.fecha.month, r.ratio_exposicion_externa) for r in rows[1:]] == [(4, None)]
    assert float(rows[0].ratio_exposicion_externa_pct) == 20.0


def test_real_exchange_rate_needs_its_base_month(national):
    assert views.real_exchange_rate(national, "1990-01-01").count() == 0


def test_loan_to_deposit_zone_limits(spark):
    days = months(2024, 5)
    t = {
        "credito": column(spark, "credito", days, [74.9, 75.0, 85.0, 85.1, None]),
        "bm": column(spark, "m3a", days, [100.0] * 5),
    }
    zones = measures.loan_to_deposit_zones(t).orderBy("fecha").collect()
    assert [r.estado_ldr_valor for r in zones] == [1, 2, 2, 3, 0]


def test_override_and_local_reserves(spark):
    days = months(2024, 2)
    tc = column(spark, "tc", days, [36.5, 36.6]).withColumn("rin", F.lit(2.0))
    patch = spark.createDataFrame([(days[0], 40.0)], "fecha date, tc double")
    patched = views.override(tc, patch, "tc").orderBy("fecha").collect()
    assert [r.tc for r in patched] == [40.0, 36.6]
    t = {"rin": tc.select("fecha", "rin"), "tc": tc.filter(F.col("fecha") == days[0])}
    local = views.reserves_local_currency(t)
    assert dict(local.dtypes)["rin_nio"] == "decimal(14,6)"
    assert [float(r.rin_nio or 0) for r in local.orderBy("fecha").collect()] == [73.0, 0.0]


def test_catalogue_answers_sql(spark, national):
    names, lacking = catalog.register(spark, national, "1995-01-01")
    assert set(catalog.VIEWS) <= set(names) and not lacking
    top = spark.sql(
        "SELECT moneda, spread_CP FROM vw_spread_bancario WHERE fecha = DATE'2000-01-01' ORDER BY 1"
    ).collect()
    assert [r.moneda for r in top] == ["ME", "MN"]
    one = {"cpi_usa": national["cpi_usa"]}
    with pytest.raises(ValueError, match="vw_macroeconomico"):
        catalog.register(spark, one)
    only, lacking = catalog.register(spark, one, partial=True)
    assert only == ["cpi_usa", "vw_inflacion_usa"]
    assert lacking["vw_brecha_deslizamiento"] == ["ipc", "tc"]
    assert set(lacking) == set(catalog.VIEWS) - set(only)
