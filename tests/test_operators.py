from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from lunario.operators import (
    attach_constant,
    clean_simple,
    collapse_duplicates,
    delete_where,
    densify,
    fill_down,
    fill_within_group,
    key_violations,
    last_non_blank,
    month_calendar,
    period_change,
    previous_value,
    profile,
    running_count,
    update_from,
    upsert,
)


def months(first_year: int, count: int) -> list[date]:
    return [date(first_year + i // 12, i % 12 + 1, 1) for i in range(count)]


def rows(df, *order):
    return [tuple(row) for row in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def gapped(spark):
    """36 months of two series; the second lacks two consecutive months."""
    days = months(2021, 36)
    data = [("a", d, float(100 + i)) for i, d in enumerate(days)]
    data += [("b", d, float(200 + i)) for i, d in enumerate(days) if i not in (9, 10)]
    return spark.createDataFrame(data, "entidad string, fecha date, x double")


def test_modes_agree_without_gaps(gapped):
    whole = gapped.filter("entidad = 'a'")
    results = [
        rows(period_change(whole, {"x": "y"}, 12, mode, keys=["entidad"]), "fecha")
        for mode in ("row", "calendar", "join")
    ]
    assert results[0] == results[1] == results[2]


def test_gap_moves_rows_but_not_the_calendar(gapped):
    changed = {
        mode: {
            (r.entidad, r.fecha): r.p
            for r in previous_value(gapped, {"x": "p"}, 12, mode, keys=["entidad"]).collect()
        }
        for mode in ("row", "calendar", "join")
    }
    assert changed["calendar"] == changed["join"]
    assert changed["calendar"][("b", date(2022, 10, 1))] is None
    assert changed["calendar"][("b", date(2022, 12, 1))] == 211.0
    assert changed["row"][("b", date(2022, 10, 1))] is not None
    assert changed["row"] != changed["calendar"]


def test_densified_lag_is_the_calendar(gapped):
    full = densify(gapped, keys=["entidad"])
    assert full.count() == 72
    lagged = previous_value(full, {"x": "p"}, 12, keys=["entidad"]).filter("x IS NOT NULL")
    calendar = previous_value(gapped, {"x": "p"}, 12, "calendar", keys=["entidad"])
    assert rows(lagged, "entidad", "fecha") == rows(calendar, "entidad", "fecha")


def test_leap_day_compares_with_the_last_of_february(spark):
    df = spark.createDataFrame(
        [(date(2023, 2, 28), 1.0), (date(2024, 2, 28), 2.0), (date(2024, 2, 29), 3.0)],
        "fecha date, x double",
    )
    for mode in ("calendar", "join"):
        assert rows(previous_value(df, {"x": "p"}, 12, mode), "fecha") == [
            (date(2023, 2, 28), 1.0, None),
            (date(2024, 2, 28), 2.0, 1.0),
            (date(2024, 2, 29), 3.0, 1.0),
        ]


def test_zero_previous_gives_null(spark):
    df = spark.createDataFrame(
        [(date(2024, 1, 1), 0.0), (date(2024, 2, 1), 5.0)], "fecha date, x double"
    )
    assert rows(period_change(df, {"x": "y"}, 1), "fecha")[1][2] is None


def test_unknown_mode(gapped):
    with pytest.raises(ValueError):
        previous_value(gapped, {"x": "p"}, mode="week")


def brute_fill(data):
    out, last, count = {}, {}, {}
    for file, line, value in sorted(data):
        if value is not None:
            last[file] = value
            count[file] = count.get(file, 0) + 1
        out[(file, line)] = (last.get(file), count.get(file, 0))
    return out


def test_two_pass_fill_and_count_match_one_pass(spark):
    """Blocks of very different sizes, some without a header; one file holds most lines."""
    source = random.Random(7)
    data = []
    for file, size in (("hot", 4000), ("cold", 150), ("late", 90)):
        for line in range(size):
            header = source.random() < (0.002 if file == "hot" else 0.03)
            data.append((file, line * 171, 2000 + line % 50 if header else None))
    data = [row for row in data if not (row[0] == "late" and row[1] < 9000 and row[2])]
    source.shuffle(data)
    df = spark.createDataFrame(data, "archivo string, linea long, anio int").repartition(7)
    filled = fill_down(df, "anio", "real", "linea", ["archivo"])
    counted = running_count(df, "anio", "grupo", "linea", ["archivo"])
    expected = brute_fill(data)
    assert {(r.archivo, r.linea): r.real for r in filled.collect()} == {
        key: value[0] for key, value in expected.items()
    }
    assert {(r.archivo, r.linea): r.grupo for r in counted.collect()} == {
        key: value[1] for key, value in expected.items()
    }


def test_fill_within_group(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (1, 3), (2, None)], "g int, x int")
    assert sorted((r.g, r.y) for r in fill_within_group(df, "x", "y", ["g"]).collect()) == sorted(
        [(1, 5), (1, 5), (1, 5), (2, None)], key=lambda p: (p[0], p[1] or 0)
    )


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(
        [(date(2024, 1, 1), 1.0, 10.0), (date(2024, 2, 1), 2.0, 20.0)],
        "fecha date, x double, y double",
    )


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(
        [(date(2024, 2, 1), None, 21.0), (date(2024, 3, 1), 3.0, None)],
        "fecha date, x double, y double",
    )


MERGED = [
    (date(2024, 1, 1), 1.0, 10.0),
    (date(2024, 2, 1), None, 21.0),
    (date(2024, 3, 1), 3.0, None),
]


def test_upsert(target, source):
    once = upsert(target, source, ["fecha"])
    assert rows(once, "fecha") == MERGED
    assert rows(upsert(once, source, ["fecha"]), "fecha") == MERGED
    assert rows(upsert(target, source.limit(0), ["fecha"]), "fecha") == rows(target, "fecha")


def test_a_doubled_source_key_is_an_error(target, source):
    doubled = source.unionByName(source.limit(1))
    with pytest.raises(Exception, match="twice"):
        upsert(target, doubled, ["fecha"]).collect()
    with pytest.raises(Exception, match="twice"):
        update_from(target, doubled, ["fecha"], {"y": F.col("new_y")}, ["y"]).count()


def test_null_keys_are_keys(spark):
    """A NULL file, series or group behaves like a named one, also across blocks."""
    data = [(f, n, 2000 + n if n in (1, 150) else None) for f in (None, "a") for n in range(1, 300)]
    df = spark.createDataFrame(data, "archivo string, linea long, anio int").withColumn(
        "bloque", (F.col("linea") / 100).cast("int")
    )
    filled = fill_down(df, "anio", "real", "linea", ["archivo"], "bloque")
    counted = running_count(df, "anio", "grupo", "linea", ["archivo"], "bloque")
    for file in (None, "a"):
        own = F.col("archivo").eqNullSafe(F.lit(file))
        years = [r.real for r in filled.filter(own).orderBy("linea").collect()]
        groups = [r.grupo for r in counted.filter(own).orderBy("linea").collect()]
        assert years == [2001] * 149 + [2150] * 150
        assert groups == [1] * 149 + [2] * 150
    tops = fill_within_group(df, "anio", "top", ["archivo"])
    assert {r.top for r in tops.collect()} == {2150} and tops.count() == len(data)
    months = spark.createDataFrame(
        [(None, date(2020, 1, 15), 1.0), (None, date(2020, 3, 10), 3.0)],
        "k string, fecha date, x double",
    )
    assert rows(densify(months, keys=["k"]), "fecha") == [
        (None, date(2020, 1, 1), 1.0), (None, date(2020, 2, 1), None), (None, date(2020, 3, 1), 3.0)
    ]


def test_months_off_day_one(spark):
    df = spark.createDataFrame(
        [(date(2020, 1, 15), 1.0), (date(2020, 2, 10), 2.0)], "fecha date, x double"
    )
    assert [r.fecha for r in month_calendar(df).orderBy("fecha").collect()] == [
        date(2020, 1, 1), date(2020, 2, 1)
    ]
    assert rows(densify(df), "fecha") == [(date(2020, 1, 1), 1.0), (date(2020, 2, 1), 2.0)]


def test_clean_simple_drops_empty_rows_alone(spark):
    texts = ["1.5", "NaN", "Infinity", "5f", "0x1p3", "n.d.", "-2e3", " ", None]
    raw = spark.createDataFrame([(t,) for t in texts], "x string")
    cleaned = [r.x for r in clean_simple(raw, {"x": "double"}).collect()]
    assert sorted(cleaned, key=str) == sorted([1.5, None, None, None, None, None, -2000.0], key=str)


def test_update_from_keeps_unmatched_rows(target, source):
    updated = update_from(target, source, ["fecha"], {"y": F.col("new_y") + F.col("y")}, ["y"])
    assert rows(updated, "fecha") == [(date(2024, 1, 1), 1.0, 10.0), (date(2024, 2, 1), 2.0, 41.0)]


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame(
        [(date(1899, 12, 30),), (date(2024, 1, 1),), (None,)], "fecha date"
    )
    kept = delete_where(df, F.col("fecha") == F.lit("1899-12-30").cast("date"))
    assert {r.fecha for r in kept.collect()} == {date(2024, 1, 1), None}


def test_key_violations(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    assert {tuple(r) for r in key_violations(df, ["k"]).collect()} == {(1, 2, 0), (None, 1, 1)}
    unique = collapse_duplicates(df.filter("k IS NOT NULL"), ["k"])
    assert key_violations(unique, ["k"]).count() == 0
    assert {tuple(r) for r in unique.collect()} == {(1, "b"), (2, "c")}


def test_profile_of_zeros_and_nulls(spark):
    df = spark.createDataFrame(
        [(date(2024, 1, 1), 0.0), (date(2024, 2, 1), None), (date(2024, 3, 1), 4.0)],
        "fecha date, x double",
    )
    assert tuple(profile(df, "x").first()) == (3, date(2024, 1, 1), date(2024, 3, 1), 1, 1)


def test_last_non_blank(spark):
    df = spark.createDataFrame(
        [
            ("a", date(2024, 1, 1), 9.0),
            ("a", date(2024, 2, 1), 1.0),
            ("a", date(2024, 2, 1), 4.0),
            ("a", date(2024, 3, 1), None),
            ("b", date(2024, 3, 1), None),
        ],
        "entidad string, fecha date, x double",
    )
    assert rows(last_non_blank(df, "x", keys=["entidad"]), "entidad") == [
        ("a", date(2024, 2, 1), 4.0)
    ]
    assert rows(last_non_blank(df, "x"), "fecha") == [(date(2024, 2, 1), 4.0)]
    assert rows(last_non_blank(df, "x", keys=["fecha"]), "fecha") == [
        (date(2024, 1, 1), 9.0),
        (date(2024, 2, 1), 4.0),
    ]
    assert last_non_blank(df.limit(0), "x").count() == 0


def test_attach_constant(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, x double")
    top = {"top": F.max(F.when(F.col("k") == "a", F.col("x")))}
    assert rows(attach_constant(df, df, top), "x") == [
        ("a", 1.0, 3.0), ("a", 3.0, 3.0), ("b", 5.0, 3.0)
    ]
    assert rows(attach_constant(df, df, top, ["k"]), "x") == [("a", 1.0, 3.0), ("a", 3.0, 3.0)]
    missing = {"top": F.max(F.when(F.col("k") == "z", F.col("x")))}
    assert attach_constant(df, df, missing).count() == 0
    assert attach_constant(df, df, missing, required=False).count() == 3
