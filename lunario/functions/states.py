"""Threshold states: one rule table gives the text label and its numeric twin."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class State:
    """A label and code that hold where ``when`` is true; earlier states win."""

    label: str
    code: int
    when: Column


def classify(
    states: Sequence[State], otherwise: tuple[str | None, int | None] = (None, None)
) -> tuple[Column, Column]:
    """Text and code columns of the first state that holds.

    A NULL comparison holds for no state, so a row with missing input gets ``otherwise``.
    """

    def chain(pick, default) -> Column:
        cases = reduce(
            lambda built, state: built.when(state.when, F.lit(pick(state))),
            states[1:],
            F.when(states[0].when, F.lit(pick(states[0]))),
        )
        return cases.otherwise(F.lit(default))

    return chain(lambda s: s.label, otherwise[0]), chain(lambda s: s.code, otherwise[1])
