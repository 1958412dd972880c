from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lunario.functions import (
    amount,
    cell_text,
    is_summary,
    month_name,
    month_number,
    percent_change,
    ratio,
    shift_months,
    text_label,
    year_label,
)
from lunario.plans.measures import macro_state


def evaluate(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [row[0] for row in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_amount(spark):
    cells = {
        "1,234.5": Decimal("1234.5"),
        " 12 ": Decimal("12"),
        "1 234.5": Decimal("1234.5"),
        "(1,234.5)": Decimal("-1234.5"),
        "( 7 )": Decimal("-7"),
        "(1 234)": None,
        "-3.25": Decimal("-3.25"),
        "1.23456": Decimal("1.2346"),
        "-": None,
        "": None,
        "n.d.": None,
        "1e5": None,
        "(2E3)": None,
        None: None,
    }
    assert evaluate(spark, list(cells), amount) == list(cells.values())


def test_labels(spark):
    labels = ["2024", " 2025 p/ ", "Enero 1/", "MARZO*", "may", "12", "20245", "Promedio", None]
    assert evaluate(spark, labels, year_label) == [
        "2024", "2025", None, None, None, None, "2024", None, None
    ]
    assert evaluate(spark, labels, text_label) == [
        None, None, "Enero 1/", "MARZO*", None, None, None, "Promedio", None
    ]
    assert evaluate(spark, labels, month_number) == [
        None, None, 1, 3, None, None, None, None, None
    ]
    assert evaluate(spark, ["Promedio anual", "Enero (PROMEDIO)", "Enero"], is_summary) == [
        True, True, False
    ]


def test_cell_text(spark):
    assert evaluate(spark, [" 4.06 ", "-", " - ", "", "  ", None], cell_text) == [
        "4.06", None, None, None, None, None
    ]


def test_dates(spark):
    days = [date(2024, 2, 29), date(2023, 12, 31), None]
    back = evaluate(spark, days, lambda c: shift_months(c, -12), "date")
    assert back == [date(2023, 2, 28), date(2022, 12, 31), None]
    assert evaluate(spark, days, month_name, "date") == ["febrero", "diciembre", None]


def test_guarded_arithmetic(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0), (1.0, None)], "a double, b double")
    rows = df.select(ratio(F.col("a"), F.col("b")), percent_change(F.col("a"), F.col("b"))).collect()
    assert [tuple(row) for row in rows] == [(None, None), (1.5, 50.0), (None, None)]


@pytest.mark.parametrize(
    "growth, inflation, text, code",
    [
        (0.035, 0.03, "Expansión con anclaje", 1),
        (0.035, 0.0301, "Expansión con presión", 2),
        (0.0349, 0.03, "Desaceleración controlada", 3),
        (0.0, 0.031, "Estanflación", 4),
        (None, 0.03, "Sin datos", 0),
        (0.04, None, "Sin datos", 0),
    ],
)
def test_macro_state(spark, growth, inflation, text, code):
    df = spark.createDataFrame([(growth, inflation)], "g double, i double")
    assert tuple(df.select(*macro_state(F.col("g"), F.col("i"))).first()) == (text, code)
