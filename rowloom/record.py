"""Record proxies: what lambdas see while a plan is built. Reading a field gives a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .field import Field, FieldPin, Header


class FieldCycleError(RuntimeError):
    """Post-fields that need one another. Raised when the plan is built, with the path."""

    def __init__(self, path: list[Field]):
        super().__init__("fields need one another: " + " -> ".join(f.name for f in path))
        self.path = path


class Record:
    """Maps the fields of a header to columns of a DataFrame under construction."""

    def __init__(self, header: Header, prefix: str = "", nil_marker: str | None = None):
        self.header, self._prefix, self._marker = header, prefix, nil_marker

    def __getitem__(self, field: Field | FieldPin) -> Column:
        if isinstance(field, FieldPin):
            if field.index >= len(self.header) or self.header.fields[field.index] is not field.field:
                raise KeyError(f"{field} is not of this header")
            field = field.field
        if field not in self.header:
            raise KeyError(f"no field {field} in {self.header}")
        return F.col(self._prefix + field.column)

    get = __getitem__

    def is_nil(self) -> Column:
        """True where an outer join found no record on this side."""
        return F.col(self._marker).isNull() if self._marker else F.lit(False)

    def values(self) -> list[Column]:
        return [self[f] for f in self.header]

    def as_struct(self) -> Column:
        return F.struct(*[self[f].alias(f.name) for f in self.header])


class Value:
    """Stands for the elements of a plain stream: the record of ``map_to_record`` over one column."""

    def __init__(self, column: Column):
        self.column = column


class _Tracing(Record):
    """Notes which fields a post-field reads."""

    def __init__(self, header: Header):
        super().__init__(header)
        self.read: list[Field] = []

    def __getitem__(self, field):
        column = super().__getitem__(field)
        self.read.append(field.field if isinstance(field, FieldPin) else field)
        return column

    get = __getitem__


def typed(field: Field, column: Column) -> Column:
    return column.cast(field.dtype) if field.dtype else column


def with_post_fields(df: DataFrame, header: Header, posts: dict[Field, Callable[[Record], Column]]) -> DataFrame:
    """Add post-fields in the order of their needs, a projection for each depth, so that nothing is evaluated twice."""
    needs: dict[Field, list[Field]] = {}
    columns: dict[Field, Column] = {}
    for field, fn in posts.items():
        record = _Tracing(header)
        columns[field] = typed(field, as_column(fn(record)))
        needs[field] = [f for f in record.read if f in posts]
    depth: dict[Field, int] = {}

    def visit(field: Field, path: list[Field]) -> int:
        if field in path:
            raise FieldCycleError([*path[path.index(field) :], field])
        if field not in depth:
            depth[field] = 1 + max((visit(f, [*path, field]) for f in needs[field]), default=0)
        return depth[field]

    for field in posts:
        visit(field, [])
    for level in range(1, 1 + max(depth.values(), default=0)):
        df = df.withColumns({f.column: columns[f] for f in posts if depth[f] == level})
    return df


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
