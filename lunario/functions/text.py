"""Reading the label column and the number cells of a report-shaped file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish month names as the reports print them, January first.
MONTHS = (
    "enero",
    "febrero",
    "marzo",
    "abril",
    "mayo",
    "junio",
    "julio",
    "agosto",
    "septiembre",
    "octubre",
    "noviembre",
    "diciembre",
)

#: A number as text: digits with an optional sign, decimal point and exponent.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Fixed value: word that marks a yearly summary row.
SUMMARY_WORD = "promedio"


def year_label(label: Column) -> Column:
    """The four digits that open a year header (``2025 p/`` gives ``2025``), else NULL."""
    trimmed = F.trim(label)
    return F.when(trimmed.rlike("^[0-9]{4}"), F.substring(trimmed, 1, 4))


def text_label(label: Column) -> Column:
    """The trimmed label of a row that may name a month: four characters or more, no year."""
    trimmed = F.trim(label)
    return F.when((F.length(trimmed) >= 4) & ~trimmed.rlike("^[0-9]{4}"), trimmed)


def is_summary(label: Column) -> Column:
    """True for rows holding a yearly mean instead of a month."""
    return F.contains(F.lower(label), F.lit(SUMMARY_WORD))


def month_number(label: Column) -> Column:
    """Month 1-12 named at the start of a label, footnote marks allowed; NULL for other text."""
    opening = F.regexp_extract(F.lower(label), f"^({'|'.join(MONTHS)})", 1)
    position = F.array_position(F.array(*[F.lit(name) for name in MONTHS]), opening)
    return F.nullif(position, F.lit(0)).cast("int")


def amount(cell: Column, kind: str = "decimal(18,4)") -> Column:
    """Number in a report cell: thousands commas dropped, parentheses negative, junk NULL.

    Blanks inside the digits are dropped too, except inside parentheses, where they make the
    cell unreadable. Exponent notation is text, not a number.
    """
    trimmed = F.trim(cell)
    bracketed = trimmed.like("(%)")
    # The exponent letter becomes one no number has; the characters after it are deleted.
    digits = F.when(bracketed, F.translate(trimmed, "eE,()", "xx")).otherwise(
        F.translate(trimmed, "eE, ", "xx")
    )
    value = digits.try_cast(kind)
    return F.when(bracketed, F.negate(value)).otherwise(value)


def cell_text(cell: Column) -> Column:
    """Trimmed cell, NULL when it is blank or a lone dash."""
    trimmed = F.trim(cell)
    return F.when(~trimmed.isin("", "-"), trimmed)
