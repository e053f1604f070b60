"""Ordered rules: one list of predicates serves a record on the driver and every row of a table.

A predicate is written once, with comparisons joined by ``&``. Given a record it sees values and
gives a bool; given :data:`COLUMNS` it sees the columns of the same names and gives a Column. A missing
value (None, null) breaks every rule that reads it, in either form.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Any], Any]


class Columns:
    """The columns of a table, or the fields of a struct column, as attributes."""

    def __init__(self, struct: Column | None = None) -> None:
        self._struct = struct

    def __getattr__(self, name: str) -> Column:
        return F.col(name) if self._struct is None else self._struct[name]


COLUMNS = Columns()


def count(held: Any) -> Any:
    """How many members a set, or an array column, has."""
    return F.size(held) if isinstance(held, Column) else len(held)


def finite(value: Any) -> Any:
    """Whether a number is neither negative nor NaN nor infinite."""
    return (value >= 0) & (value < math.inf)


class Rules:
    """Reasons in a fixed order, each with the predicate that must hold."""

    def __init__(self, *rules: tuple[str, Predicate]) -> None:
        self.rules = rules

    def broken(self, record: Any) -> tuple[str, ...]:
        """Every reason against one record."""
        return tuple(reason for reason, holds in self.rules if not self._holds(holds, record))

    def check(self, record: Any) -> None:
        """ValueError with the first reason against one record."""
        for reason, holds in self.rules:
            if not self._holds(holds, record):
                raise ValueError(reason)

    def broken_in(self, columns: Any = COLUMNS) -> Column:
        """Every reason against each row, as an array."""
        listed = F.array(*(F.when(~F.coalesce(holds(columns), F.lit(False)), F.lit(reason)) for reason, holds in self.rules))
        return F.filter(listed, lambda x: x.isNotNull())

    def first_in(self, columns: Any = COLUMNS) -> Column:
        """The first reason against each row; null where all rules hold."""
        return F.coalesce(*(F.when(~F.coalesce(holds(columns), F.lit(False)), F.lit(reason)) for reason, holds in self.rules))

    @staticmethod
    def _holds(holds: Predicate, record: Any) -> bool:
        try:
            return bool(holds(record))
        except TypeError:  # None has no order
            return False
