"""DataFrame operators: calendar, change, shape, fill, upkeep, profile."""

from lunario.operators.calendar import calendar_dimension, densify, month_calendar
from lunario.operators.change import period_change, previous_value
from lunario.operators.fill import fill_down, fill_within_group, running_count
from lunario.operators.profile import key_counts, last_non_blank, latest, profile
from lunario.operators.shape import (
    attach_constant,
    conditional_pivot,
    spine_join,
    unpivot_cells,
)
from lunario.operators.upkeep import (
    add_columns,
    clean_simple,
    collapse_duplicates,
    delete_where,
    key_violations,
    update_from,
    upsert,
)

__all__ = [
    "add_columns",
    "attach_constant",
    "calendar_dimension",
    "clean_simple",
    "collapse_duplicates",
    "conditional_pivot",
    "delete_where",
    "densify",
    "fill_down",
    "fill_within_group",
    "key_counts",
    "key_violations",
    "last_non_blank",
    "latest",
    "month_calendar",
    "period_change",
    "previous_value",
    "profile",
    "running_count",
    "spine_join",
    "unpivot_cells",
    "update_from",
    "upsert",
]
