"""Collectors: aggregate functions with a defined value for empty input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..field import Field, FieldPin
from ..record import as_column

Guard = Callable[[Column], Column]


def value_of(what, x) -> Column:
    """``what`` of an input: a field, a function, or None for the input itself (a routed value, or the record as a struct)."""
    if what is None:
        return x if isinstance(x, Column) else x.as_struct()
    if isinstance(what, (Field, FieldPin)):
        return x[what]
    return as_column(what(x))


class Collector:
    """Spark aggregates of an input (a record or a routed value), and an expression over their results.

    ``parts(x, guard)`` gives the aggregates; ``guard`` turns a value into null where a row does not count, and every value that
    is aggregated must pass through it. ``finish`` gets the results in the same order.
    """

    def __init__(self, parts: Callable[[object, Guard], list[Column]], finish: Callable[..., Column] = lambda x: x):
        self.parts, self.finish = parts, finish

    def aggregate(self, x, condition: Column | None = None) -> Column:
        guard = (lambda c: c) if condition is None else (lambda c: F.when(condition, c))
        return self.finish(*self.parts(x, guard))

    def over(self, x, window) -> Column:
        return self.finish(*[part.over(window) for part in self.parts(x, lambda c: c)])

    def and_then(self, finish: Callable[[Column], Column]) -> Collector:
        return Collector(self.parts, lambda *results: finish(self.finish(*results)))


def counting() -> Collector:
    return Collector(lambda x, guard: [F.count(guard(F.lit(1)))])


def summing(what=None) -> Collector:
    """0 for no input; null values count as nothing."""
    return Collector(lambda x, guard: [F.sum(guard(value_of(what, x)))], lambda s: F.coalesce(s, F.lit(0)))


def averaging(what=None) -> Collector:
    """0.0 for no input."""
    return Collector(lambda x, guard: [F.avg(guard(value_of(what, x)))], lambda a: F.coalesce(a, F.lit(0.0)))


def minimum(what=None) -> Collector:
    return Collector(lambda x, guard: [F.min(guard(value_of(what, x)))])


def maximum(what=None) -> Collector:
    return Collector(lambda x, guard: [F.max(guard(value_of(what, x)))])


def summarizing(what=None) -> Collector:
    """A struct of count, sum, avg, min and max from one pass; min and max of nothing are null."""

    def parts(x, guard):
        v = guard(value_of(what, x))
        return [F.count(v), F.sum(v), F.avg(v), F.min(v), F.max(v)]

    def finish(n, s, a, lo, hi):
        return F.struct(n.alias("count"), F.coalesce(s, F.lit(0)).alias("sum"), F.coalesce(a, F.lit(0.0)).alias("avg"), lo.alias("min"), hi.alias("max"))

    return Collector(parts, finish)


def to_list(what=None) -> Collector:
    """Nulls are left out and the order is open; ``to_list().and_then(F.array_sort)`` settles it."""
    return Collector(lambda x, guard: [F.collect_list(guard(value_of(what, x)))])


def to_set(what=None) -> Collector:
    """Nulls are left out; an array without repeats in open order."""
    return Collector(lambda x, guard: [F.collect_set(guard(value_of(what, x)))])


def counting_distinct(what=None) -> Collector:
    return Collector(lambda x, guard: [F.count_distinct(guard(value_of(what, x)))])


def summing_distinct(what=None) -> Collector:
    return Collector(lambda x, guard: [F.sum_distinct(guard(value_of(what, x)))], lambda s: F.coalesce(s, F.lit(0)))


def mapping(what, downstream: Callable[..., Collector]) -> Collector:
    """``mapping(field, to_set)``: the downstream collector over a value of each record."""
    return downstream(what)


def collecting_and_then(collector: Collector, finish: Callable[[Column], Column]) -> Collector:
    return collector.and_then(finish)


def record_set(configure) -> Collector:
    """Nested records: an array of structs. ``configure`` gets an object with ``field(field, mapper)``."""

    def parts(x, guard):
        defs: dict[Field, Column] = {}

        class Into:
            def field(self, field, mapper=None):
                defs[field] = value_of(field if mapper is None else mapper, x)

        configure(Into())
        return [F.collect_list(guard(F.struct(*[c.alias(f.name) for f, c in defs.items()])))]

    return Collector(parts)


def folding(zero: Column, step: Callable[[Column, Column], Column], what=None, finish: Callable[[Column], Column] | None = None) -> Collector:
    """A custom fold over the sorted values of a group, inside the JVM. It gathers each group's values: for groups that fit in memory."""
    return Collector(lambda x, guard: [F.collect_list(guard(value_of(what, x)))], lambda values: F.aggregate(F.array_sort(values), zero, step, finish))


def custom(aggregate: Callable[[Column], Column], what=None) -> Collector:
    """Any Spark aggregate, also a grouped-aggregate pandas UDF, over a value of each record."""
    return Collector(lambda x, guard: [aggregate(guard(value_of(what, x)))])
