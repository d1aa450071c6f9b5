"""Column bindings: which columns of a table play which role."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Binding:
    """Roles of the columns of a panel.

    ``key`` identifies a series, ``ts`` orders it and ``tiebreak`` makes that
    order total. Every operator takes its columns from here, so the same code
    runs over any table.
    """

    key: tuple[str, ...]
    ts: str
    tiebreak: tuple[str, ...] = field(default=())
    values: tuple[str, ...] = field(default=())

    def order(self) -> list[Column]:
        """Total order inside a series; a missing timestamp sorts last."""
        return [col(c).asc_nulls_last() for c in (self.ts, *self.tiebreak)]


def quoted(name: str) -> str:
    """Backtick-quote a column name (names may hold ``.`` and ``-``)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))
