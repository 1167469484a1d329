"""Grouped aggregation with hidden keys, shared accumulations, routing and post-fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..field import Field, FieldPin, Header
from ..functions.collectors import Collector
from ..record import Record, as_column, typed, with_post_fields


@dataclass
class KeyField:
    column: Column


@dataclass
class Agg:
    collector: Collector


@dataclass
class SharedAgg:
    owner: Aggs
    fn: Callable[[Column], Column]


@dataclass
class Routed:
    route: Route
    collector: Collector


@dataclass
class Post:
    fn: Callable[[Record], Column]


class Keys:
    """Several keys from one intermediate result."""

    def __init__(self, parent: Aggregate, value: Column):
        self.parent, self.value = parent, value

    def key(self, fn: Callable[[Column], Column]) -> Keys:
        self.parent.hidden.append(as_column(fn(self.value)))
        return self

    def key_field(self, field: Field, fn: Callable[[Column], Column]) -> Keys:
        self.parent.defs[field] = KeyField(as_column(fn(self.value)))
        return self


class Aggs:
    """Several columns from one accumulation."""

    def __init__(self, parent: Aggregate, collector: Collector):
        self.parent, self.collector = parent, collector

    def agg_field(self, field: Field, fn: Callable[[Column], Column]) -> Aggs:
        self.parent.defs[field] = SharedAgg(self, fn)
        return self


class Route:
    """Children aggregate the values that records emit to them. ``emit(record)`` lists (condition, field, value)."""

    def __init__(self, parent: Aggregate, emit):
        self.parent, self.emit = parent, emit

    def agg_field(self, field: Field, collector: Collector) -> Route:
        self.parent.defs[field] = Routed(self, collector)
        return self


class Aggregate:
    def __init__(self, record: Record):
        self.record = record
        self.defs: dict[Field, object] = {}
        self.hidden: list[Column] = []

    def key(self, what) -> Aggregate:
        """Group by it, without a column in the output."""
        self.hidden.append(self.record[what] if isinstance(what, (Field, FieldPin)) else as_column(what(self.record)))
        return self

    def keys(self, *what) -> Aggregate:
        """Hidden keys, or ``keys(mapper, configure)`` for keys of one intermediate result."""
        if len(what) == 2 and not isinstance(what[0], (Field, FieldPin)):
            what[1](Keys(self, as_column(what[0](self.record))))
            return self
        for f in what:
            self.key(f)
        return self

    def key_field(self, field: Field | FieldPin, fn: Callable[[Record], Column] | None = None) -> Aggregate:
        column = self.record[field] if fn is None else as_column(fn(self.record))
        self.defs[field.field if isinstance(field, FieldPin) else field] = KeyField(column)
        return self

    def key_fields(self, *fields: Field) -> Aggregate:
        for f in fields:
            self.key_field(f)
        return self

    def agg_field(self, field: Field, collector: Collector) -> Aggregate:
        self.defs[field] = Agg(collector)
        return self

    def aggs(self, collector: Collector, configure: Callable[[Aggs], None]) -> Aggregate:
        configure(Aggs(self, collector))
        return self

    def route(self, emit, configure: Callable[[Route], None]) -> Aggregate:
        configure(Route(self, emit))
        return self

    def post_field(self, field: Field, fn: Callable[[Record], Column]) -> Aggregate:
        self.defs[field] = Post(fn)
        return self

    def apply(self, df: DataFrame) -> tuple[DataFrame, Header]:
        """One aggregation for all. Definitions are final before keys are chosen: without a key left, there is one row, always."""
        header = Header(self.defs)
        keys = {f.column: typed(f, d.column) for f, d in self.defs.items() if isinstance(d, KeyField)}
        keys |= {f"__key_{i}": c for i, c in enumerate(self.hidden)}
        read: dict[Field, tuple[Column, Column, bool]] = {}  # of routed fields: value, condition, whether rows were multiplied
        routes = list(dict.fromkeys(d.route for d in self.defs.values() if isinstance(d, Routed)))
        wanted = {r: {f for f, d in self.defs.items() if isinstance(d, Routed) and d.route is r} for r in routes}
        spread: dict[Route, list] = {}
        for route in routes:
            emitted = [e for e in route.emit(self.record) if e[1] in wanted[route]]
            if len({f for _, f, _ in emitted}) == len(emitted):  # at most one for each field: no row is multiplied
                read |= {f: (as_column(v), F.coalesce(as_column(c), F.lit(False)), False) for c, f, v in emitted}
            else:
                spread[route] = emitted
        main: Column | None = None
        for i, (route, emitted) in enumerate(spread.items()):
            if i:
                raise ValueError("only one route may emit to the same field more than once")
            targets = sorted({f for _, f, _ in emitted}, key=list(self.defs).index)
            kinds = {f: df.select(as_column(next(v for _, t, v in emitted if t is f)).alias("v")).schema[0].dataType for f in targets}
            made = []
            for c, f, v in emitted:
                values = [(as_column(v) if t is f else F.lit(None)).cast(kinds[t]).alias(f"v{j}") for j, t in enumerate(targets)]
                made.append(F.when(F.coalesce(as_column(c), F.lit(False)), F.struct(F.lit(targets.index(f)).alias("target"), *values)))
            if keys:
                df = df.withColumns(keys)
                keys = {name: F.col(name) for name in keys}
            df = df.select("*", F.posexplode_outer(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("__at", "__emitted"))
            main = F.coalesce(F.col("__at") == 0, F.lit(True))  # the first copy of each record stands for it
            read |= {f: (F.col(f"__emitted.v{j}"), F.coalesce(F.col("__emitted.target") == j, F.lit(False)), True) for j, f in enumerate(targets)}
        columns: dict[str, Column] = {}
        shared: dict[Aggs, str] = {}
        for f, d in self.defs.items():
            if isinstance(d, Agg):
                columns[f.column] = typed(f, d.collector.aggregate(self.record, main))
            elif isinstance(d, SharedAgg) and d.owner not in shared:
                shared[d.owner] = f"__agg_{len(shared)}"
                columns[shared[d.owner]] = d.owner.collector.aggregate(self.record, main)
            elif isinstance(d, Routed):
                value, condition, multiplied = read.get(f, (F.lit(None), F.lit(False), False))
                if main is not None and not multiplied:
                    condition = condition & main
                columns[f.column] = typed(f, d.collector.aggregate(value, condition))
        if not columns:
            out = df.select(*[c.alias(n) for n, c in keys.items()]).distinct() if keys else df.agg(F.count(F.lit(1)).alias("__n"))
        else:
            out = df.groupBy(*[c.alias(n) for n, c in keys.items()]) if keys else df
            out = out.agg(*[c.alias(n) for n, c in columns.items()])
        children = {f: as_column(d.fn(F.col(shared[d.owner]))) for f, d in self.defs.items() if isinstance(d, SharedAgg)}
        out = out.select("*", *[typed(f, c).alias(f.column) for f, c in children.items()])
        posts = {f: d.fn for f, d in self.defs.items() if isinstance(d, Post)}
        if posts:
            out = with_post_fields(out, header, posts)
        return out.select(*[f.column for f in header]), header

