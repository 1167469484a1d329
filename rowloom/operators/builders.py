"""Configurators: what the lambdas of ``map_to_record`` and ``select`` fill in.

Definitions sit in a dict in the order of columns; defining a field again replaces its definition and keeps its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..field import Field, FieldPin, Header
from ..functions.analytics import Analytic, Partition
from ..ordering import keys_of
from ..record import Record, as_column, typed, with_post_fields


@dataclass
class Plain:
    column: Column


@dataclass
class Shared:
    """A column made from an intermediate result that siblings share."""

    owner: object
    fn: Callable[[Column], Column]


@dataclass
class Post:
    fn: Callable[[Record], Column]


@dataclass
class Windowed:
    window: Window
    keys: list
    fn: Analytic


class Fields:
    """Several columns from one intermediate result, which is computed once for each record."""

    def __init__(self, parent, value: Column):
        self.parent, self.value = parent, value

    def field(self, field: Field, fn: Callable[[Column], Column]) -> Fields:
        self.parent.defs[field] = Shared(self, fn)
        return self


class Projection:
    """What all projecting configurators share."""

    def __init__(self):
        self.defs: dict[Field, object] = {}

    def post_field(self, field: Field, fn: Callable[[Record], Column]):
        self.defs[field] = Post(fn)
        return self

    def plain(self, field: Field, column: Column):
        self.defs[field] = Plain(column)
        return self

    def share(self, value: Column, configure: Callable[[Fields], None]):
        configure(Fields(self, value))
        return self

    def apply(self, df: DataFrame, carried: list[str]) -> tuple[DataFrame, Header]:
        """Windows one after the other, then intermediates, plain columns, and post-fields over the output record."""
        header = Header(self.defs)
        owners = list(dict.fromkeys(d.owner for d in self.defs.values() if isinstance(d, Shared)))
        out: dict[Field, Column] = {}
        for i, (field, d) in enumerate(self.defs.items()):
            out[field] = None  # keeps the order of definitions
            if isinstance(d, Windowed):
                column, df = d.window.run(df, d)
                df = df.withColumn(f"__win_{i}", column)
                out[field] = F.col(f"__win_{i}")
        temps = {owner: f"__shared_{i}" for i, owner in enumerate(owners)}
        if temps:
            df = df.withColumns({name: owner.value for owner, name in temps.items()})
        for field, d in self.defs.items():
            if isinstance(d, Plain):
                out[field] = d.column
            elif isinstance(d, Shared):
                out[field] = as_column(d.fn(F.col(temps[d.owner])))
        df = df.select(*[typed(f, c).alias(f.column) for f, c in out.items() if c is not None], *carried)
        posts = {f: d.fn for f, d in self.defs.items() if isinstance(d, Post)}
        if posts:
            df = with_post_fields(df, header, posts)
        return df.select(*[f.column for f in header], *carried), header


class Into(Projection):
    """Elements of a plain stream to records."""

    def __init__(self, value: Column | Record):
        super().__init__()
        self.value = value

    def field(self, field: Field, fn: Callable) -> Into:
        return self.plain(field, as_column(fn(self.value)))


class Select(Projection):
    def __init__(self, record: Record):
        super().__init__()
        self.record = record

    def all_fields(self) -> Select:
        return self.fields(*self.record.header)

    def all_fields_except(self, *excluded: Field) -> Select:
        no_repeats(excluded)
        return self.fields(*[f for f in self.record.header if f not in excluded])

    def field(self, field: Field | FieldPin, fn: Callable[[Record], Column] | None = None) -> Select:
        column = self.record[field] if fn is None else as_column(fn(self.record))
        return self.plain(field.field if isinstance(field, FieldPin) else field, column)

    def fields(self, *what) -> Select:
        """Copies of fields, or ``fields(mapper, configure)``."""
        if len(what) == 2 and not isinstance(what[0], (Field, FieldPin)):
            return self.share(as_column(what[0](self.record)), what[1])
        for f in what:
            self.field(f)
        return self

    def window(self, configure: Callable[[Window], None]) -> Select:
        configure(Window(self))
        return self


def no_repeats(fields) -> None:
    if len(set(fields)) != len(fields):
        raise ValueError("a field is excluded twice")


class Window:
    """Analytic functions over the partitions of some keys. Without keys all rows are one partition, in one task."""

    def __init__(self, parent: Select):
        self.parent = parent
        self._keys: list[tuple[Column | None, Callable | None]] = []

    def key(self, what) -> Window:
        record = self.parent.record
        self._keys.append((record[what] if isinstance(what, (Field, FieldPin)) else as_column(what(record)), None))
        return self

    def keys(self, *what) -> Window:
        """Fields, or ``keys(mapper, configure)`` for keys of one intermediate result."""
        if len(what) == 2 and not isinstance(what[0], (Field, FieldPin)):
            shared = as_column(what[0](self.parent.record))
            outer = self

            class Keys:
                parent = outer

                def key(self, fn):
                    outer._keys.append((as_column(fn(shared)), None))
                    return self

            what[1](Keys())
            return self
        for f in what:
            self.key(f)
        return self

    def field(self, field: Field, *rest) -> Window:
        """``field(field, fn)``, or ``field(field, [sort keys], fn)``."""
        by, fn = rest if len(rest) == 2 else ([], rest[0])
        self.parent.defs[field] = Windowed(self, keys_of(by), fn)
        return self

    def fields(self, *args) -> Window:
        """``fields([sort keys], configure)``, ``fields(mapper, configure)`` or ``fields([sort keys], mapper, configure)``.

        Functions of ``configure``'s fields see the sort's order; with a mapper they are called with its result.
        """
        by = args[0] if isinstance(args[0], (list, tuple)) else []
        mapper = next((a for a in args[:-1] if callable(a)), None)
        outer = self

        class Children:
            parent = outer

            def field(self, field, fn):
                made = fn if mapper is None else (lambda p, fn=fn: fn(mapper)(p))
                outer.parent.defs[field] = Windowed(outer, keys_of(by), made)
                return self

        args[-1](Children())
        return self

    def run(self, df: DataFrame, d: Windowed) -> tuple[Column, DataFrame]:
        record = self.parent.record
        order = [k.sorted(k.column(record)) for k in d.keys]
        partition = Partition(df, record, [c for c, _ in self._keys], order)
        column = as_column(d.fn(partition))
        return column, partition.df
