from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lunario.functions.text import MONTHS
from lunario.plans.reports import (
    dated_lines,
    load_aggregate_csv,
    load_aggregate_csv_into,
    load_aggregate_staging,
    load_rate_csv,
    load_rate_staging,
    merge_aggregates,
    tidy_aggregates,
    tidy_rates,
)
from lunario.sources import (
    append,
    read_aggregate_report,
    read_comma_table,
    read_rate_report,
    read_table,
    replace,
    snapshot,
)
from lunario.sources.schemas import AGGREGATE_CELLS, RATE_COLUMNS, TABLES

HEADER = ",".join(["anio_mes", *AGGREGATE_CELLS])


def line(label: str, base: str = "", m1: str = "", m3a: str = "") -> str:
    cells = [""] * 12
    cells[0], cells[1], cells[11] = base, m1, m3a
    return ",".join(f'"{cell}"' for cell in [label, *cells])


@pytest.fixture
def report(tmp_path):
    path = tmp_path / "report_agg.csv"
    path.write_text(
        "\n".join(
            [
                HEADER,
                line("2024"),
                line("Enero 1/", "1,234.5", "(1,234.5)", " 12 "),
                line("Febrero*", "-", "", "n.d."),
                line("MARZO", "7", "8", "9"),
                line("Promedio", "1", "1", "1"),
                line(""),
                line("2025 p/"),
                line("Enero", "10", "20", "30"),
                line("Enero", "11", "", "5"),
                line("Fuente: propia"),
            ]
        ),
        encoding="utf-8",
    )
    return str(path)


EXPECTED = {
    date(2024, 1, 1): (Decimal("1234.5"), Decimal("-1234.5"), Decimal("12")),
    date(2024, 2, 1): (None, None, None),
    date(2024, 3, 1): (Decimal(7), Decimal(8), Decimal(9)),
    date(2025, 1, 1): (Decimal(11), Decimal(20), Decimal(30)),
}


def months_of(df):
    return {r.fecha: (r.base_monetaria, r.m1, r.m3a) for r in df.collect()}


def test_aggregate_report(spark, report):
    assert months_of(tidy_aggregates(read_aggregate_report(spark, report))) == EXPECTED


def test_load_jobs(spark, report, tmp_path):
    stored = spark.createDataFrame(
        [(date(2023, 12, 1), *[Decimal(1)] * 7), (date(2024, 2, 1), *[Decimal(2)] * 7)],
        TABLES["bm"],
    )
    merged = load_aggregate_csv(spark, report, stored, str(tmp_path / "v1"))
    expected = {date(2023, 12, 1): (Decimal(1),) * 3, **EXPECTED}
    assert months_of(merged) == expected
    staging = read_aggregate_report(spark, report).withColumn(
        "source_row_id", F.col("linea").cast("int")
    )
    again = load_aggregate_staging(spark, staging, merged, str(tmp_path / "v2"))
    assert months_of(again) == expected
    with pytest.raises(Exception, match="(?i)exists"):
        snapshot(again, str(tmp_path / "v1"))


def test_year_reaches_months_in_later_splits(spark, tmp_path):
    """A file cut into many splits, with year headers far from their months."""
    lines, expected = [HEADER], {}
    for year in range(1900, 2020):
        lines.append(line(str(year)))
        for number, name in enumerate(MONTHS, 1):
            lines += [line("Nota larga sin datos " + "x" * 60)] * 6
            lines.append(line(name.capitalize(), f"{year},{number:03d}.5"))
            expected[date(year, number, 1)] = Decimal(f"{year}{number:03d}.5")
    path = tmp_path / "many_years.csv"
    path.write_text("\n".join(lines), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = read_aggregate_report(spark, str(path))
        assert raw.select("bloque").distinct().count() > 5
        parsed = {r.fecha: r.base_monetaria for r in tidy_aggregates(raw).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parsed == expected


def test_rate_report(spark, tmp_path):
    names = list(RATE_COLUMNS)

    def rates(label, **cells):
        return ";".join([label, *[cells.get(name, "") for name in names]])

    path = tmp_path / "report_rates.csv"
    path.write_bytes(
        "\n".join(
            [
                rates("Año y mes"),
                rates("2024"),
                rates("Enero", mn_pasiva_ahorro=" 1.5 ", me_activa_largo="9", mn_pasiva_1y=" - "),
                rates("Febrero 2/", mn_pasiva_mas1y="4.06", me_pasiva_3m="-"),
                rates("Promedio", mn_pasiva_ahorro="3"),
            ]
        ).encode("iso-8859-1")
    )
    raw = read_rate_report(spark, str(path))
    assert raw.filter(F.col("fecha") == "Año y mes").count() == 1
    assert {tuple(r) for r in tidy_rates(raw).collect()} == {
        (date(2024, 1, 1), "MN", "Pasiva", "Depósitos de ahorro", "Sin plazo fijo", 1.5),
        (date(2024, 1, 1), "ME", "Activa", "Préstamo", "Largo Plazo", 9.0),
        (date(2024, 2, 1), "MN", "Pasiva", "Depósitos a Plazo", "Más de 1 año", 4.06),
    }


def test_bad_rate_stops_the_load(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(f"2024;{';' * 17}\nEnero;abc{';' * 17}\n", encoding="iso-8859-1")
    with pytest.raises(Exception, match="not a rate: abc"):
        tidy_rates(read_rate_report(spark, str(path))).collect()


@pytest.mark.parametrize("cell", ["NaN", "Infinity", "5f", "7d", "0x1p3"])
def test_text_that_only_a_cast_takes_for_a_number(spark, cell):
    staging = spark.createDataFrame([(1, "2024", None), (2, "Enero", cell)],
                                    "linea int, fecha string, mn_pasiva_1m string")
    wide = staging.withColumns(
        {n: F.lit(None).cast("string") for n in RATE_COLUMNS if n != "mn_pasiva_1m"}
    )
    with pytest.raises(Exception, match="not a rate"):
        tidy_rates(wide, within=(), block=None).collect()


def test_rate_load_jobs(spark, tmp_path):
    path = tmp_path / "rates.csv"
    path.write_text(f"2024;{';' * 17}\nEnero;1.5{';' * 17}\n", encoding="iso-8859-1")
    loaded = load_rate_csv(spark, str(path), str(tmp_path / "v1"))
    assert [(r.fecha, r.moneda, r.tasa_porcentaje) for r in loaded.collect()] == [
        (date(2024, 1, 1), "MN", 1.5)
    ]
    staging = read_rate_report(spark, str(path)).withColumn("source_row_id", F.col("linea"))
    again = load_rate_staging(spark, staging, str(tmp_path / "v2"))
    assert again.collect() == loaded.collect()


def test_load_leaves_other_periods_files_alone(spark, report, tmp_path):
    table = tmp_path / "bm"
    stored = spark.createDataFrame(
        [(date(2023, 12, 1), *[Decimal(1)] * 7), (date(2024, 2, 1), *[Decimal(2)] * 7)],
        TABLES["bm"],
    )
    replace(stored, str(table), ["fecha"])

    def files(day):
        return {(p.name, p.stat().st_mtime_ns) for p in (table / f"fecha={day}").iterdir()}

    before, touched = files("2023-12-01"), files("2024-02-01")
    merged = load_aggregate_csv_into(spark, report, str(table), str(tmp_path / "staged"))
    assert months_of(merged) == {date(2023, 12, 1): (Decimal(1),) * 3, **EXPECTED}
    assert files("2023-12-01") == before and files("2024-02-01") != touched
    with pytest.raises(ValueError, match="DATE"):
        wrong = tmp_path / "wrong"
        stored.withColumn("fecha", F.concat(F.lit("m"), "fecha")).write.partitionBy("fecha").parquet(
            str(wrong)
        )
        load_aggregate_csv_into(spark, report, str(wrong), str(tmp_path / "staged2"))


def test_month_before_any_year_has_no_date(spark):
    staging = spark.createDataFrame([(1, "Enero"), (2, "2024"), (3, "Enero")], "linea int, l string")
    lines = dated_lines(staging, "l", within=(), block=None)
    assert {r["_date"] for r in lines.collect()} == {None, date(2024, 1, 1)}


def test_merge_into_keyed_table(spark):
    schema = "entidad int, " + TABLES["bm"]
    stored = spark.createDataFrame(
        [(e, date(2024, m, 1), *[Decimal(e)] * 7) for e in (1, 2) for m in (1, 2)], schema
    )
    fresh = spark.createDataFrame([(2, date(2024, 2, 1), *[None] * 7)], schema)
    merged = merge_aggregates(stored, fresh, ["entidad"])
    assert {(r.entidad, r.fecha.month): r.m1 for r in merged.collect()} == {
        (1, 1): 1, (1, 2): 1, (2, 1): 2, (2, 2): None
    }


def test_tables_and_simple_csv(spark, tmp_path):
    csv = tmp_path / "cpi.csv"
    csv.write_text("fecha,valor\n2024-01-01,310.3\n2024-02-01,0\n", encoding="utf-8")
    cpi = read_comma_table(spark, str(csv), TABLES["cpi_usa"])
    path = str(tmp_path / "cpi")
    replace(cpi, path)
    append(cpi, path)
    assert read_table(spark, path).count() == 4
    replace(cpi, path)
    assert read_table(spark, path).count() == 2
    wider = read_table(spark, path, "fecha date, cpi_usa decimal(13,4), nueva double")
    assert wider.filter("nueva IS NULL").count() == 2
