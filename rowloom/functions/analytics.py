"""Analytic functions over whole partitions. Ranks are longs that start at ``first``.

Each is a function of a ``Partition`` that gives a Column, so own ones are written the same way. Ranks by other ties than the
sort's compare consecutive records only.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ordering import keys_of
from .collectors import Collector, value_of

_names = itertools.count()


@dataclass
class Partition:
    """What an analytic function works on. ``temp`` adds a column to ``df`` that later steps read."""

    df: DataFrame
    record: object
    keys: list[Column]
    order: list[Column]

    def whole(self):
        return W.partitionBy(*self.keys).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def ordered(self):
        if not self.order:
            raise ValueError("this analytic function needs an order: window.field(field, [keys], function)")
        return W.partitionBy(*self.keys).orderBy(*self.order)

    def running(self):
        return self.ordered().rowsBetween(W.unboundedPreceding, W.currentRow)

    def temp(self, column: Column) -> Column:
        name = f"__step_{next(_names)}"
        self.df = self.df.withColumn(name, column)
        return F.col(name)

    def size(self) -> Column:
        if not self.keys:  # a number for all rows: no window over the whole table
            return self.temp(self.df.agg(F.count(F.lit(1))).scalar())
        return F.count(F.lit(1)).over(self.whole())


Analytic = Callable[[Partition], Column]


def from_agg(collector: Collector) -> Analytic:
    """The aggregate of the partition, for each of its records. Without keys it is one scalar for all."""
    return lambda p: collector.over(p.record, p.whole()) if p.keys else p.temp(p.df.agg(collector.aggregate(p.record)).scalar())


def row_number(first: int = 1) -> Analytic:
    return lambda p: F.row_number().over(p.ordered()).cast("long") - 1 + first


def _new_group(p: Partition, by) -> Column:
    """True for a record that differs from the one before it."""
    tie = F.struct(*[k.column(p.record).alias(f"k{i}") for i, k in enumerate(keys_of(by))])
    place = p.temp(F.row_number().over(p.ordered()))
    before = p.temp(F.lag(tie).over(p.ordered()))
    return p.temp((place == 1) | ~tie.eqNullSafe(before))


def rank(first: int = 1, by=None) -> Analytic:
    """With gaps after ties. ``by``: keys of the ties, where they are not those of the sort."""

    def fn(p: Partition) -> Column:
        if by is None:
            return F.rank().over(p.ordered()).cast("long") - 1 + first
        new = _new_group(p, by)
        place = p.temp(F.row_number().over(p.ordered()))
        return F.max(F.when(new, place)).over(p.running()).cast("long") - 1 + first

    return fn


def dense_rank(first: int = 1, by=None) -> Analytic:
    def fn(p: Partition) -> Column:
        if by is None:
            return F.dense_rank().over(p.ordered()).cast("long") - 1 + first
        return F.sum(_new_group(p, by).cast("long")).over(p.running()) - 1 + first

    return fn


def n_tile(first: int, n: int) -> Analytic:
    """Earlier groups take the remainder."""
    if n < 1:
        raise ValueError("n_tile needs at least one group")
    return lambda p: F.ntile(n).over(p.ordered()).cast("long") - 1 + first


def link(what, offset: int, default=None) -> Analytic:
    """The value ``offset`` records later (earlier if negative); ``default`` only beyond the partition's ends."""

    def fn(p: Partition) -> Column:
        value = value_of(what, p.record)
        if not offset:
            return value
        return F.lead(value, offset, default).over(p.ordered()) if offset > 0 else F.lag(value, -offset, default).over(p.ordered())

    return fn


def _run_end(p: Partition, by) -> tuple[Column, Column]:
    """First and last place of the record's run of ties."""
    run = p.temp(F.sum(_new_group(p, by).cast("long")).over(p.running()))
    place = p.temp(F.row_number().over(p.ordered()))
    own = W.partitionBy(*p.keys, run)
    return p.temp(F.min(place).over(own)), p.temp(F.max(place).over(own))


def cume_dist(by=None) -> Analytic:
    return lambda p: F.cume_dist().over(p.ordered()) if by is None else _run_end(p, by)[1] / p.size()


def percent_rank(by=None) -> Analytic:
    """0 for a single record."""

    def fn(p: Partition) -> Column:
        if by is None:
            return F.percent_rank().over(p.ordered())
        first, n = _run_end(p, by)[0], p.temp(p.size())
        return F.when(n > 1, (first - 1) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)

    return fn


def _at(p: Partition, what, index: Column) -> Column:
    """The value at a place of the sorted partition, counted from 0. No partition is gathered: two window passes that can spill."""
    place = p.temp(F.row_number().over(p.ordered()) - 1)
    return F.max(F.when(place == index, value_of(what, p.record))).over(p.whole())


def _checked(p: float) -> float:
    if not 0 <= p <= 1:
        raise ValueError("a percentile lies between 0 and 1")
    return float(p)


def percentile_disc(fraction: float, what) -> Analytic:
    """The record nearest to fraction * (n - 1), the lower of two equally near ones: not SQL's percentile_disc."""
    fraction = _checked(fraction)

    def fn(p: Partition) -> Column:
        index = p.temp(F.ceil(F.lit(fraction) * (p.size() - 1) - 0.5))
        return _at(p, what, index)

    return fn


def percentile_cont(fraction: float, what) -> Analytic:
    """Interpolated at fraction * (n - 1)."""
    fraction = _checked(fraction)

    def fn(p: Partition) -> Column:
        exact = p.temp(F.lit(fraction) * (p.size() - 1))
        low, high = p.temp(_at(p, what, F.floor(exact))), p.temp(_at(p, what, F.ceil(exact)))
        return low + (exact - F.floor(exact)) * (high - low)

    return fn


def pandas_analytic(fn: Callable, dtype: str) -> Analytic:
    """An opaque function of each partition, opted into: ``fn(pandas.DataFrame)`` gives one value or one for each record.

    The frame has the input's fields under their display names, in the window's order, and is a copy. Any other number of values is
    an error. A partition must fit in a task's memory; built-in functions have no such limit.
    """

    def build(p: Partition) -> Column:
        out = f"__step_{next(_names)}"
        names = {f.column: f.name for f in p.record.header}
        at = p.temp(F.row_number().over(p.ordered()) if p.order else F.lit(0))._jc.toString()
        keys = [p.temp(k)._jc.toString() for k in p.keys]

        def run(frame):
            frame = frame.sort_values(at, kind="stable")
            values = list(fn(frame[list(names)].rename(columns=names)))
            if len(values) not in (1, len(frame)):
                raise ValueError(f"an analytic function gave {len(values)} values for {len(frame)} records")
            return frame.assign(**{out: values * len(frame) if len(values) == 1 else values})

        schema = ", ".join(f"`{c}` {t}" for c, t in p.df.dtypes) + f", `{out}` {dtype}"
        p.df = p.df.groupBy(*keys).applyInPandas(run, schema)
        return F.col(out)

    return build
