"""Readers with declared schemas and writers that never touch the files being read."""

from lunario.sources.files import (
    read_aggregate_report,
    read_comma_table,
    read_rate_report,
    read_semicolon_table,
    with_line_order,
)
from lunario.sources.schemas import AGGREGATE_REPORT, CURRENCIES, RATE_REPORT, TABLES, inline_rows
from lunario.sources.tables import append, read_table, replace, replace_periods, snapshot

__all__ = [
    "AGGREGATE_REPORT",
    "CURRENCIES",
    "RATE_REPORT",
    "TABLES",
    "append",
    "inline_rows",
    "read_aggregate_report",
    "read_comma_table",
    "read_rate_report",
    "read_semicolon_table",
    "read_table",
    "replace",
    "replace_periods",
    "snapshot",
    "with_line_order",
]
