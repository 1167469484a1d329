"""Sort keys with nulls lowest, and comparison of rows by them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .field import Field, FieldPin
from .record import as_column


class SortKey:
    """A key of a sort: a field or a function of the record. By default null is the lowest value, as everywhere here."""

    def __init__(self, what, descending: bool = False, nulls_first: bool | None = None):
        self.what, self.descending = what, descending
        self.nulls_first = (not descending) if nulls_first is None else nulls_first

    def column(self, record) -> Column:
        return record[self.what] if isinstance(self.what, (Field, FieldPin)) else as_column(self.what(record))

    def sorted(self, column: Column) -> Column:
        if self.descending:
            return column.desc_nulls_first() if self.nulls_first else column.desc_nulls_last()
        return column.asc_nulls_first() if self.nulls_first else column.asc_nulls_last()

    def before(self, a: Column, b: Column) -> Column:
        """Two-valued: a comes before b."""
        plain = a > b if self.descending else a < b
        null_case = a.isNull() & b.isNotNull() if self.nulls_first else a.isNotNull() & b.isNull()
        return F.coalesce(plain, null_case)


def asc(what, nulls_first: bool | None = None) -> SortKey:
    return SortKey(what, False, nulls_first)


def desc(what, nulls_first: bool | None = None) -> SortKey:
    return SortKey(what, True, nulls_first)


def keys_of(by) -> list[SortKey]:
    return [k if isinstance(k, SortKey) else SortKey(k) for k in by]


def lexicographic(keys: list[SortKey], left: list[Column], right: list[Column]) -> Column:
    """Two-valued: the row of ``left`` comes strictly before that of ``right``."""
    out, equal = F.lit(False), F.lit(True)
    for k, a, b in zip(keys, left, right):
        out = out | (equal & k.before(a, b))
        equal = equal & a.eqNullSafe(b)
    return out
