"""Fields and headers: typed column identities and ordered, duplicate-free lists of them."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

from pyspark.sql import Column

_ids = itertools.count()


class Field:
    """A column identity. Two fields of the same name are different columns; the name is for display only.

    With ``dtype`` (a Spark type name) every definition of the field is cast to it.
    """

    def __init__(self, name: str, dtype: str | None = None):
        if name is None:
            raise TypeError("a field needs a name")
        self.name, self.dtype = name, dtype
        self.column = f"{re.sub(r'[^0-9A-Za-z]', '_', name)}_{next(_ids)}"

    def get(self, record):
        return record[self]

    def __repr__(self) -> str:
        return self.name


class FieldPin:
    """A field together with its place in one header."""

    def __init__(self, field: Field, index: int):
        self.field, self.index = field, index

    def get(self, record):
        return record[self]

    def __eq__(self, other) -> bool:
        return isinstance(other, FieldPin) and self.field is other.field and self.index == other.index

    def __hash__(self) -> int:
        return hash((id(self.field), self.index))

    def __repr__(self) -> str:
        return f"{self.field}@{self.index}"


class Header:
    """The fields of a stream in their order. Equal to a header of the same fields in the same order."""

    def __init__(self, fields):
        self.fields = tuple(fields)
        self._places = {f: i for i, f in enumerate(self.fields)}
        if len(self._places) != len(self.fields):
            raise ValueError("a header has each field once")

    def index_of(self, field: Field) -> int:
        return self._places.get(field, -1)

    def pin(self, field: Field) -> FieldPin:
        if field not in self._places:
            raise KeyError(f"no field {field} in {self}")
        return FieldPin(field, self._places[field])

    def select_all_fields(self, into) -> None:
        """Re-project every field, for use inside ``map_to_record``: of a record, or of a struct by display names."""
        for f in self.fields:
            into.field(f, lambda value, f=f: value.getField(f.name) if isinstance(value, Column) else value[f])

    def __iter__(self) -> Iterator[Field]:
        return iter(self.fields)

    def __len__(self) -> int:
        return len(self.fields)

    def __contains__(self, field) -> bool:
        return field in self._places

    def __eq__(self, other) -> bool:
        return isinstance(other, Header) and self.fields == other.fields

    def __hash__(self) -> int:
        return hash(self.fields)

    def __repr__(self) -> str:
        return f"[{', '.join(f.name for f in self.fields)}]"
