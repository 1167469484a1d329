"""Eight joins over one predicate algebra.

Equalities become equi-joins. Comparisons and intervals become equi-joins as well, of ranges: the values of one side are cut into
ranges of about RANGE_ROWS rows by a sample of them; each of its rows goes to the one range that holds it, and each row of the other
side to all ranges that can hold a partner. A pair meets once, and but for the ranges at the ends all pairs that meet are results: a
row of the other side is compared with at most two ranges in vain, and has as many copies as RANGE_ROWS goes into its results. A
frequent value is a range of its own. Whether an interval holds any point, or lies around one, is settled in the ranges of its ends.
Alternatives become a union of such joins, of which each leaves out what earlier ones found. Only opaque conditions and inequalities compare all with all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..field import Field, Header
from ..record import Record, as_column
from .builders import Projection, no_repeats
from .predicates import FLIPPED, Interval, On, Pred, null_safe
from .predicates import LEFT as SIDE_LEFT
from .predicates import RIGHT as SIDE_RIGHT

LEFT, RIGHT = "l__", "r__"
LEFT_MARK, RIGHT_MARK = "l__there", "r__there"


class JoinSelect(Projection):
    """The output of a join. A field that both sides give keeps its first place and the later side's value."""

    def __init__(self, left: Record, right: Record):
        super().__init__()
        self.left, self.right = left, right

    def _copy(self, record: Record, fields) -> JoinSelect:
        for f in fields:
            self.plain(f, record[f])
        return self

    def left_all_fields(self) -> JoinSelect:
        return self._copy(self.left, self.left.header)

    def right_all_fields(self) -> JoinSelect:
        return self._copy(self.right, self.right.header)

    def left_all_fields_except(self, *excluded: Field) -> JoinSelect:
        no_repeats(excluded)
        return self._copy(self.left, [f for f in self.left.header if f not in excluded])

    def right_all_fields_except(self, *excluded: Field) -> JoinSelect:
        no_repeats(excluded)
        return self._copy(self.right, [f for f in self.right.header if f not in excluded])

    def left_field(self, field: Field) -> JoinSelect:
        return self._copy(self.left, [field])

    def right_field(self, field: Field) -> JoinSelect:
        return self._copy(self.right, [field])

    def left_fields(self, *fields: Field) -> JoinSelect:
        return self._copy(self.left, fields)

    def right_fields(self, *fields: Field) -> JoinSelect:
        return self._copy(self.right, fields)

    def field(self, field: Field, fn: Callable[[Record, Record], object]) -> JoinSelect:
        return self.plain(field, as_column(fn(self.left, self.right)))

    def fields(self, fn: Callable[[Record, Record], object], configure) -> JoinSelect:
        return self.share(as_column(fn(self.left, self.right)), configure)


def prefixed(df: DataFrame, header: Header, prefix: str, mark: str | None) -> DataFrame:
    columns = [F.col(f.column).alias(prefix + f.column) for f in header]
    return df.select(*columns, *([F.lit(True).alias(mark)] if mark else []))


#: A range of values holds about so many rows, apart from those of a single value.
RANGE_ROWS = 1024
#: About so many ranges where copies do not come with results.
FEW = 64
BUCKET, OTHER, CUTS, SURE = "__bucket", "__bucket_of", "__cuts", "__sure"
STEPS = [1 << i for i in range(30, -1, -1)]


def cuts_of(df: DataFrame, value: Column, most: int | None = None) -> Column:
    """A scalar: sorted values of ``df`` that cut it into ranges, the least and the greatest among them; about ``most`` if given.

    A value is drawn by its hash, with a chance that grows with its rows, so that every use of the column gives the same ones, and
    frequent values are cuts.
    """
    counted = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    chance = F.lit(1.0) - F.pow(F.lit(1.0 - 1.0 / RANGE_ROWS), F.col("n"))
    drawn = F.when(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < chance, F.col("v"))
    found = counted.agg(F.array_sort(F.collect_set(drawn)).alias("some"), F.array_compact(F.array(F.min("v"), F.max("v"))).alias("ends"))
    some = F.col("some") if most is None else F.filter("some", lambda c, i: i % F.ceil(F.size("some") / F.lit(most)) == 0)
    return found.select(F.array_sort(F.array_union(some, "ends"))).scalar()


def leading(items: Column, test: Callable[[Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    """How many elements of a sorted array pass a test that its first elements pass and no others: a binary search."""
    steps = F.slice(F.array(*[F.lit(s) for s in STEPS]), -F.length(F.bin(F.size(items))), len(STEPS))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(test(F.get(items, n + step - 1)), n + step).otherwise(n), finish)


def bucket(value: Column) -> Column:
    """The n-th cut has the range 2n - 1 to itself, the values up to the next cut have 2n, null has -1: those of one value are odd."""
    cuts = F.col(CUTS)
    return F.when(value.isNull(), -1).otherwise(leading(cuts, lambda c: c <= value, lambda n: 2 * n - F.coalesce(F.get(cuts, n - 1) == value, F.lit(False)).cast("int")))


def odd(at: Column) -> Column:
    return (at % 2 != 0).cast("int")


def dealt(df: DataFrame, name: str) -> DataFrame:
    """Ranges over as many tasks as shuffles have: how much a join gives does not follow from the size of what it reads, so few files,
    a broadcast or merged partitions must not leave it to few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), name)


def ranged(df: DataFrame, cuts: Column, **made: Column) -> DataFrame:
    """With columns that read CUTS, made once: a filter on them would be moved below a projection and repeat their searches."""
    once = F.explode(F.array(F.struct(*[c.alias(name) for name, c in made.items()])))
    return df.withColumn(CUTS, cuts).withColumn("__made", once).select(*df.columns, *[F.col(f"__made.{name}").alias(name) for name in made])


def sides_of(one: DataFrame, other: DataFrame, pred: Pred, side: int, most: int | None = None) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with their ranges, and when a pair meets. ``one`` is of the given side, and in one range each; an interval's point
    must be of that side."""
    if isinstance(pred.search, Interval):
        value, low, high = pred.search.point, pred.search.low, pred.search.high
        first, last = F.col("__low"), F.least("__high", "__top")
    else:
        op, a, b = pred.search
        value, partner, below = (a, b, op in ("gt", "gte")) if side == SIDE_LEFT else (b, a, op in ("lt", "lte"))
        low = high = partner
        skipped = odd(F.col("__low")) if op in ("gt", "lt") else F.lit(0)  # its own value
        first, last = (F.col("__low") + skipped, F.col("__top")) if below else (F.lit(-1), F.least(F.col("__low") - skipped, F.col("__top")))
    cuts = cuts_of(one, value, most)
    ends = {"__low": bucket(low)} | ({} if high is low else {"__high": bucket(high)})
    theirs = ranged(other, cuts, **ends, __top=2 * F.size(CUTS) - 1)  # nothing is greater than the last cut
    theirs = theirs.where(first <= last).select(*other.columns, F.explode(F.sequence(first, last)).alias(OTHER))
    return dealt(ranged(one, cuts, **{BUCKET: bucket(value)}), BUCKET), dealt(theirs, OTHER), (F.col(BUCKET) == F.col(OTHER)) & pred.column


def met(one: DataFrame, other: DataFrame, pred: Pred, side: int, how: str) -> DataFrame:
    """Join by ``pred.search``. Where only the rows of ``one`` are asked for, copies are not as many as results: fewer ranges."""
    mine, theirs, on = sides_of(one, other, pred, side, None if how == "inner" else FEW)
    return mine.join(theirs, on, how).drop(BUCKET, OTHER)


def settled(kept: DataFrame, sure: Column, other: DataFrame, other_at: str, on: Column, how: str, columns: list[str]) -> DataFrame:
    """Rows that are sure to have a partner, and those that have one in their range."""
    kept = kept.withColumn(SURE, F.explode(F.array(F.coalesce(sure, F.lit(False))))).drop(CUTS)
    rest = dealt(kept.where(~F.col(SURE)), BUCKET).join(dealt(other, other_at), (F.col(BUCKET) == F.col(other_at)) & on, how).select(*columns)
    return rest.union(kept.where(SURE).select(*columns)) if how == "left_semi" else rest


def holding(kept: DataFrame, other: DataFrame, x: Interval, how: str) -> DataFrame:
    """Rows of ``kept``, which hold the intervals, by whether a point of ``other`` lies in theirs.

    The first point from the lower end on decides. Cuts are points, so it lies in the lower end's range, or is the next cut.
    """
    cuts, point = cuts_of(other, x.point), F.col("__point")
    at = ranged(kept, cuts, **{BUCKET: bucket(x.low)}).withColumn(CUTS, cuts)
    cut = F.get(F.col(CUTS), F.floor(F.greatest(F.col(BUCKET), F.lit(0)) / 2).cast("int"))  # the lower end itself, or the next one
    points = ranged(other.select(x.point.alias("__point")).distinct(), cuts, **{OTHER: bucket(point)})
    return settled(at, (cut <= x.high) & (x.low.isNull() | (cut >= x.low)), points, OTHER, null_safe("gte", point, x.low) & null_safe("lte", point, x.high), how, kept.columns)


def lying(kept: DataFrame, other: DataFrame, x: Interval, how: str) -> DataFrame:
    """Rows of ``kept``, which hold the points, by whether theirs lies in an interval of ``other``.

    Sure are those whose whole range lies in one; else only intervals that end in the range can hold them.
    """
    cuts, low, high, first, last = cuts_of(kept, x.point), F.col("__lower"), F.col("__upper"), F.col("__first"), F.col("__last")
    held = ranged(other.select(x.low.alias("__lower"), x.high.alias("__upper")).distinct(), cuts, __first=bucket(low), __last=bucket(high)).where(first <= last)
    reach = held.groupBy("__first").agg(F.max("__last").alias("__last"))  # at most one row for each range
    reach = reach.select("__first", F.max("__last").over(Window.orderBy("__first")).alias("__last"))
    reach = reach.agg(F.array_sort(F.collect_list(F.struct("__first", "__last")))).scalar()
    at = ranged(kept, cuts, **{BUCKET: bucket(x.point)}).withColumn(CUTS, reach)
    inside = 1 - odd(F.col(BUCKET))  # a single value may be an end
    n = leading(F.col(CUTS), lambda r: r["__first"] <= F.col(BUCKET) - inside)
    ends = held.withColumn(OTHER, F.explode(F.array_distinct(F.array(first, last))))
    return settled(at, F.get(F.col(CUTS), n - 1)["__last"] >= F.col(BUCKET) + inside, ends, OTHER, null_safe("gte", x.point, low) & null_safe("lte", x.point, high), how, kept.columns)


def pairs(left: DataFrame, right: DataFrame, pred: Pred) -> DataFrame:
    """The inner join."""
    if pred.equi:
        return left.join(right, pred.column, "inner")
    if pred.search is not None:
        if isinstance(pred.search, Interval) and pred.search.point_side == SIDE_RIGHT:
            return met(right, left, pred, SIDE_RIGHT, "inner").select(*left.columns, *right.columns)
        return met(left, right, pred, SIDE_LEFT, "inner")
    if pred.parts:
        found, before = None, None
        for p in pred.parts:
            part = pairs(left, right, p if before is None else replace(p, column=p.column & ~before, parts=tuple(replace(x, column=x.column & ~before) for x in p.parts)))
            found = part if found is None else found.union(part)
            before = p.column if before is None else before | p.column
        return found
    return left.join(right, pred.column, "inner")


def having(kept: DataFrame, other: DataFrame, pred: Pred, side: int, how: str) -> DataFrame:
    """``how``: left_semi or left_anti. The rows of ``kept``, of the given side, that have a partner, or that have none."""
    if pred.range and not kept.isStreaming:
        return by_extreme(kept, other, pred.range, side, how == "left_semi")
    if pred.equi or kept.isStreaming or other.isStreaming:
        return kept.join(other, pred.column, how)
    if pred.plain:
        return (lying if pred.search.point_side == side else holding)(kept, other, pred.search, how)
    if isinstance(pred.search, Interval) and pred.search.point_side != side:
        # intervals that hold a point, as values: rows that agree in all columns share their fate
        at = [f"__value_{i}" for i in range(len(kept.columns))]
        points, intervals, on = sides_of(other, kept, pred, SIDE_LEFT + SIDE_RIGHT - side, FEW)
        found = intervals.join(points, on, "left_semi").select(*[F.col(c).alias(v) for c, v in zip(kept.columns, at)]).distinct()
        return kept.join(found, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(v)) for c, v in zip(kept.columns, at)]), how)
    if pred.search is not None:
        return met(kept, other, pred, side, how)
    if pred.parts:
        rest, found = kept, None
        for p in pred.parts:
            if how == "left_semi":
                part = having(rest, other, p, side, "left_semi")
                found = part if found is None else found.union(part)
            rest = having(rest, other, p, side, "left_anti")
        return rest if how == "left_anti" else found
    return kept.join(other, pred.column, how)


def by_extreme(kept: DataFrame, other: DataFrame, plain: tuple[str, Column, Column], side: int, wanted: bool) -> DataFrame:
    """For a single comparison the other side's extreme, one row, decides."""
    op, a, b = plain if side == SIDE_LEFT else (FLIPPED[plain[0]], plain[2], plain[1])
    key = F.struct(b.isNotNull().alias("there"), b.alias("v"))  # null lowest
    bound = other.agg((F.min(key) if op in ("gt", "gte") else F.max(key)).alias("__bound"), F.count(F.lit(1)).alias("__n"))
    hit = (F.col("__n") > 0) & null_safe(op, a, F.col("__bound.v"))
    return kept.join(F.broadcast(bound), hit if wanted else ~hit, "left_semi")  # one row


def outer_join(kind: str, left: DataFrame, left_header: Header, right: DataFrame, right_header: Header, on, select) -> tuple[DataFrame, Header]:
    """``kind``: inner, left, right or full. Sides that may be missing carry a marker that is null for nil records."""
    marks = {"inner": (None, None), "left": (None, RIGHT_MARK), "right": (LEFT_MARK, None), "full": (LEFT_MARK, RIGHT_MARK)}[kind]
    a, b = Record(left_header, LEFT, marks[0]), Record(right_header, RIGHT, marks[1])
    pred = on(On(a, b))
    one, two = prefixed(left, left_header, LEFT, marks[0]), prefixed(right, right_header, RIGHT, marks[1])
    if pred.equi or pred.search is None and not pred.parts or left.isStreaming or right.isStreaming:
        joined = one.join(two, pred.column, kind)
    else:
        joined = pairs(one, two, pred)
        if kind in ("left", "full"):
            joined = joined.unionByName(having(one, two, pred, SIDE_LEFT, "left_anti"), allowMissingColumns=True)
        if kind in ("right", "full"):
            joined = joined.unionByName(having(two, one, pred, SIDE_RIGHT, "left_anti"), allowMissingColumns=True)
    out = JoinSelect(a, b)
    select(out)
    return out.apply(joined, [])


def semi_join(kind: str, left: DataFrame, left_header: Header, right: DataFrame, right_header: Header, on) -> DataFrame:
    """``kind``: any, none, all or not_all. As predicates are two-valued, all is none of the negation."""
    a, b = Record(left_header, LEFT), Record(right_header, RIGHT)
    j = On(a, b)
    pred = on(j) if kind in ("any", "none") else j.not_(on(j))
    extra = [c for c in left.columns if c not in {f.column for f in left_header}]
    sided = left.select(*[F.col(f.column).alias(LEFT + f.column) for f in left_header], *extra)
    kept = having(sided, prefixed(right, right_header, RIGHT, None), pred, SIDE_LEFT, "left_semi" if kind in ("any", "not_all") else "left_anti")
    return kept.select(*[F.col(LEFT + f.column).alias(f.column) for f in left_header], *extra)
