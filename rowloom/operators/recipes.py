"""Compositions: set operations, pivot and unpivot, lateral join, recursion, division, nesting, range join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..field import Field, Header
from ..ordering import SortKey
from ..record import Record, as_column
from ..storage import shared_folder
from ..stream import RecordStream


def union_distinct(*streams: RecordStream) -> RecordStream:
    return RecordStream.concat(*streams).distinct()


def _same(left: RecordStream, right: RecordStream):
    pairs = list(zip(left.header, right.header, strict=True))
    return lambda j: j.all(*[j.eq(j.left(a), j.right(b)) for a, b in pairs])


def intersect(left: RecordStream, right: RecordStream) -> RecordStream:
    """Left records that the right has as well; all left repeats stay."""
    return left.left_any_match(right, _same(left, right))


def except_(left: RecordStream, right: RecordStream) -> RecordStream:
    """Left records that the right does not have; all left repeats stay."""
    return left.left_none_match(right, _same(left, right))


def unpivot(stream: RecordStream, keep: list[Field], cells: list[Field], name: Field, value: Field) -> RecordStream:
    """A row for each cell; null cells stay."""
    r = Record(stream.header)
    pairs = F.array(*[F.struct(F.lit(f.name).alias("n"), r[f].alias("v")) for f in cells])
    df = stream.df.select(*[f.column for f in keep], F.inline(pairs).alias(name.column, value.column))
    return RecordStream(df, Header([*keep, name, value]))


def lateral(stream: RecordStream, fn: Callable[[Record], Column], fields: list[Field], outer: bool = False) -> RecordStream:
    """Join each record with the elements of an array made from it: one field takes the element, several take a struct's members."""
    made = as_column(fn(Record(stream.header)))
    df = stream._plain().select("*", (F.explode_outer(made) if outer else F.explode(made)).alias("__element"))
    if len(fields) == 1:
        columns = [F.col("__element").alias(fields[0].column)]
    else:
        members = df.schema["__element"].dataType.names
        columns = [F.col(f"__element.`{m}`").alias(f.column) for m, f in zip(members, fields, strict=True)]
    return RecordStream(df.select(*[f.column for f in stream.header], *columns), Header([*stream.header, *fields]))


def nest(stream: RecordStream, keys: list[Field], nested: Field) -> RecordStream:
    """A row for each group, with its other fields as an array of structs in sorted order."""
    rest = [f for f in stream.header if f not in keys]
    made = F.array_sort(F.collect_list(F.struct(*[F.col(f.column).alias(f.name) for f in rest])))
    return RecordStream(stream.df.groupBy(*[f.column for f in keys]).agg(made.alias(nested.column)), Header([*keys, nested]))


def divide(stream: RecordStream, key: Field, item: Field, required: RecordStream) -> RecordStream:
    """Keys that go with every record of ``required`` (of one field); all keys if that is empty.

    Matches are counted, not gathered: the distinct pairs of a key that are required must be as many as the required items.
    """
    wanted = required._plain().toDF("__item").distinct()
    pairs = stream.df.select(F.col(key.column), F.col(item.column)).distinct()
    hit = pairs.join(wanted.withColumn("__hit", F.lit(1)), pairs[item.column].eqNullSafe(wanted["__item"]), "left")
    counted = hit.groupBy(key.column).agg(F.count("__hit").alias("__n"))
    total = wanted.agg(F.count(F.lit(1)).alias("t")).scalar()
    return RecordStream(counted.where(F.col("__n") == total).select(key.column), Header([key]))


def recursive(start: RecordStream, step: Callable[[RecordStream], RecordStream], max_depth: int = 100) -> RecordStream:
    """``start``, the step of it, the step of that, and so on until a step gives nothing.

    Each level is written to the shared checkpoint folder, so that lineage does not grow. Cycles end with an error at ``max_depth``.
    """
    shared_folder(start.df.sparkSession)
    level = start._with(start._plain().checkpoint(), [])
    levels = [level]
    for _ in range(max_depth):
        level = step(level)
        if level.header != start.header:
            raise ValueError(f"a step changed the header to {level.header}")
        level = level._with(level._plain().checkpoint(), [])
        if level.df.isEmpty():
            return RecordStream.concat(*levels)
        levels.append(level)
    raise RecursionError(f"not finished after {max_depth} levels: is there a cycle?")


def range_join(left: RecordStream, right: RecordStream, point: Field, low: Field, high: Field, select) -> RecordStream:
    """Inner join of points to intervals that hold them, both ends included. Rows with a null bound or point do not take part."""
    points, held = left.filter(lambda r: r[point].isNotNull()), right.filter(lambda r: r[low].isNotNull() & (r[low] <= r[high]))
    return points.join(held, lambda j: j.between(j.left(point), j.right(low), j.right(high)), select)


def top(stream: RecordStream, n: int, *by: SortKey) -> RecordStream:
    """The first n by some keys: a bounded heap in each task, then one merge."""
    return stream.sorted(*by).limit(n)
