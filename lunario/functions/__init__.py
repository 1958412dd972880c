"""Column-level helpers; every one is a built-in Spark expression."""

from lunario.functions.dates import month_name, month_start, shift_months
from lunario.functions.numbers import percent_change, ratio
from lunario.functions.states import State, classify
from lunario.functions.text import amount, cell_text, is_summary, month_number, text_label, year_label

__all__ = [
    "State",
    "amount",
    "cell_text",
    "classify",
    "is_summary",
    "month_name",
    "month_number",
    "month_start",
    "percent_change",
    "ratio",
    "shift_months",
    "text_label",
    "year_label",
]
