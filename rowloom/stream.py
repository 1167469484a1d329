"""Record streams: lazy tables with a header, on DataFrames, and plain streams of values beside them.

A stream can be used again; nothing runs before a terminal operation. Spark has no encounter order, so a stream has one only
after ``sorted`` or ``with_order``: its keys travel as hidden columns through operators that keep the order. Operators that need
an order (skip, take_while, drop_while, find_first) refuse to work without.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .field import Field, Header
from .functions.collectors import Collector
from .operators.aggregate import Aggregate
from .operators.builders import Into, Select, Windowed
from .operators.join import outer_join, semi_join
from .ordering import SortKey, desc, keys_of, lexicographic
from .record import Record, as_column

_names = itertools.count()
TIE = "__tie"
#: Values are folded so many at a time.
CHUNK = 1024
#: Equal rows are made so many at a time.
PIECE = 65_536


class Ordered:
    """What record streams and plain streams share: rows, hidden order columns, and operators that keep the row type."""

    df: DataFrame
    order: list[tuple[SortKey, str]]
    _skipped: tuple[DataFrame, int] | None = None  # the rows before skip(n), and n
    _few = False  # in one task by a limit
    _parallel = True
    _closers: tuple[Callable, ...] = ()

    def _with(self, df: DataFrame, order=None):
        raise NotImplementedError

    def _own(self) -> list[str]:
        """The visible columns."""
        raise NotImplementedError

    def _seen(self):
        """What lambdas get."""
        raise NotImplementedError

    def _test(self, predicate) -> Column:
        return F.coalesce(as_column(predicate(self._seen())), F.lit(False))

    def _batch(self, what: str) -> None:
        if self.df.isStreaming:
            raise TypeError(f"{what} is not possible on an unbounded stream")

    def _hidden(self) -> list[str]:
        return [name for _, name in self.order]

    def _plain(self) -> DataFrame:
        return self.df.select(*self._own())

    def _sort_columns(self, backwards: bool = False) -> list[Column]:
        if not self.order:
            raise ValueError("this needs an order: use sorted() or with_order() before")
        keys = [SortKey(k.what, not k.descending, not k.nulls_first) if backwards else k for k, _ in self.order]
        return [k.sorted(F.col(name)) for k, (_, name) in zip(keys, self.order)]

    def sorted(self, *by):
        """By all columns in their order, or by the given keys; null is lowest unless a key says otherwise."""
        self._batch("sorting")
        return self.with_order(*by)

    def with_order(self, *by):
        """Declare the encounter order. Nothing is sorted before an operator or terminal needs it."""
        keys = keys_of(by) if by else [SortKey(lambda _, c=c: F.col(c)) for c in self._own()]
        order = [(k, f"__order_{next(_names)}") for k in keys]
        df = self._plain().withColumns({name: k.column(self._seen()) for k, name in order})
        return self._with(df, order)

    def unordered(self):
        return self._with(self._plain(), [])

    def filter(self, predicate):
        return self._with(self.df.where(self._test(predicate)))

    def distinct(self):
        """Null equals null. Keeps no order."""
        return self._with(self._plain().distinct(), [])

    def limit(self, n: int):
        """Ordered: a bounded heap in each task and one merge, also after a skip."""
        if self._skipped:
            df, skipped = self._skipped
            made = self._with(self._with_tie(df)[0].orderBy(*self._sort_columns(), TIE).offset(skipped).limit(n).drop(TIE))
        else:
            made = self._with((self.df.orderBy(*self._sort_columns()) if self.order else self.df).limit(n))
        made._few = True
        return made

    def _with_tie(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """With a hash of all columns that orders rows whose keys tie, and the names of all that orders."""
        own = [F.col(c) for c in self._own()]
        return df.withColumn(TIE, F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit("b"), *own).alias("b"))), [*self._hidden(), TIE]

    def skip(self, n: int):
        """Without the first n. Of rows that tie, those that come first by a hash of all columns go.

        The n-th row is found by a top-n of its keys, and rows are compared with it: the table is neither sorted as a whole nor
        brought into one task. Rows that are equal to it in all columns are counted, and as many as are left are made again.
        """
        self._batch("skipping")
        keys = [k for k, _ in self.order]
        by = self._sort_columns()
        if n <= 0:
            return self._with(self.df)
        df, skipped = self._skipped or (self.df, 0)
        n += skipped
        tied, at = self._with_tie(df)
        last = tied.select(*at).orderBy(*by, TIE).offset(n - 1).limit(1).select(F.struct(*at).alias("__last")).scalar()
        marked = tied.withColumn("__last", last)
        order = [*keys, SortKey(None)]
        here, there = [F.col(c) for c in at], [F.col(f"__last.{c}") for c in at]
        # before the n-th row, of its kind, after it
        before, after = lexicographic(order, here, there), lexicographic(order, there, here)
        found = marked.where(F.col("__last").isNotNull())
        ahead = found.where(before).agg(F.count(F.lit(1))).scalar()
        rest = found.where(after).drop(TIE, "__last")
        alike = found.where(~before & ~after).groupBy(*df.columns).agg((F.count(F.lit(1)) - (n - ahead)).alias("__n")).where("__n > 0")
        out = rest.unionByName(self._repeated(alike).select(*df.columns))
        made = self._with(out)
        made._skipped = (df, n)
        return made

    def _repeated(self, df: DataFrame) -> DataFrame:
        """Each row ``__n`` times, in pieces of PIECE that many tasks make: never as one array."""
        pieces = df.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {PIECE}"))))
        pieces = pieces.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__piece")
        return pieces.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(PIECE), F.col("__n") - F.col("__piece") * PIECE))))

    def _cut(self, predicate, taken: bool):
        """The first failing row is found by a top-1, and only its keys are compared: no global window. Ties with it come after it."""
        self._batch("take_while and drop_while")
        self._sort_columns()
        names = self._hidden()
        keys = [k for k, _ in self.order]
        first = self.df.where(~self._test(predicate)).orderBy(*self._sort_columns()).limit(1).select(F.struct(*names).alias("f"))
        stop = first.scalar()
        df = self.df.withColumn("__stop", stop)
        before = F.col("__stop").isNull() | lexicographic(keys, [F.col(n) for n in names], [F.col(f"__stop.{n}") for n in names])
        return self._with(df.where(before if taken else ~before).drop("__stop"))

    def take_while(self, predicate):
        return self._cut(predicate, True)

    def drop_while(self, predicate):
        return self._cut(predicate, False)

    def peek(self, name: str, *metrics: Column):
        """Observe metrics as rows pass; rows are unchanged. Without metrics: a row count."""
        return self._with(self.df.observe(name, *(metrics or [F.count(F.lit(1)).alias("rows")])))

    def _heir(self, made, *others):
        """What goes on with a stream made from this one: handlers and the kind of execution."""
        made._parallel = self._parallel
        made._closers = tuple(dict.fromkeys(c for s in (self, *others) for c in s._closers))
        return made

    def parallel(self, partitions: int | None = None):
        made = self._with(self.df.repartition(partitions) if partitions else self.df)
        made._parallel, made._skipped = True, None if partitions else self._skipped
        return made

    def sequential(self):
        """In one task."""
        made = self._with(self.df.coalesce(1))
        made._parallel = False
        return made

    def is_parallel(self) -> bool:
        return self._parallel

    def on_close(self, handler: Callable[[], None]):
        """``handler`` runs when this stream, or one made from it, is closed; handlers run in the order they were given."""
        made = self._with(self.df)
        made._closers, made._skipped = (*self._closers, handler), self._skipped
        return made

    def close(self) -> None:
        """Run the handlers, each once; all of them run, then the first error is raised with the others noted on it."""
        handlers, self._closers = self._closers, ()
        errors = []
        for handler in handlers:
            try:
                handler()
            except Exception as e:  # noqa: BLE001
                errors.append(e)
        self.df.unpersist()
        if errors:
            for e in errors[1:]:
                errors[0].add_note(f"another handler failed: {e!r}")
            raise errors[0]

    def _rows(self) -> DataFrame:
        return (self.df.orderBy(*self._sort_columns()) if self.order else self.df).select(*self._own())

    def _spread_rows(self) -> DataFrame:
        """Sorted in as many tasks as shuffles have, for rows that are alike are small when merging is decided, and large when sorted.
        Rows that tie go by the task they come from, not all into one."""
        if not self.order or self._few:
            return self._rows()
        df, by = self.df.withColumn("__from", F.spark_partition_id()), [*self._sort_columns(), F.col("__from")]
        return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).orderBy(*by).select(*self._own())

    def count(self) -> int:
        return self.df.count()

    def any_match(self, predicate) -> bool:
        return not self.df.where(self._test(predicate)).isEmpty()

    def all_match(self, predicate) -> bool:
        return self.df.where(~self._test(predicate)).isEmpty()

    def none_match(self, predicate) -> bool:
        return not self.any_match(predicate)

    def find_first(self):
        self._sort_columns()
        return next(iter(self._rows().take(1)), None)

    def find_any(self):
        return next(iter(self._plain().take(1)), None)

    def min(self, *by):
        return self.sorted(*by).find_first()

    def max(self, *by):
        return self._with(self.df).sorted(*[SortKey(k.what, not k.descending, not k.nulls_first) for k in keys_of(by)] or [desc(lambda _, c=c: F.col(c)) for c in self._own()]).find_first()

    def iterator(self) -> Iterator:
        """Rows one after the other, a partition at a time."""
        return self._rows().toLocalIterator()

    def for_each(self, fn: Callable) -> None:
        """On the executors, in no order."""
        self._plain().foreach(fn)

    def for_each_ordered(self, fn: Callable) -> None:
        for row in self.iterator():
            fn(row)

    def reduce(self, *how, value=None):
        """``reduce(step)`` (None for no values), ``reduce(zero, step)``, or ``reduce(zero, accumulate, combine)``.

        Functions of two Columns; steps and combinations must be associative. Values are folded CHUNK at a time, in the encounter
        order if there is one, and so are the results, twice; the last fold is of a millionth of the rows.
        """
        zero, step, combine = (None, how[0], how[0]) if len(how) == 1 else (as_column(how[0]), how[1], how[-1])
        column = self._value(value)
        rows = (self.df.orderBy(*self._sort_columns()) if self.order else self.df).select(column.alias("v"), F.monotonically_increasing_id().alias("i"))
        kind = rows.schema["v"].dataType if len(how) < 3 else rows.select(zero.alias("z")).schema["z"].dataType

        def fold(values: Column, fn) -> Column:
            if zero is not None:
                return F.aggregate(values, zero.cast(kind), lambda a, b: fn(a, b).cast(kind))
            return F.aggregate(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.get(values, F.lit(0)).cast(kind), lambda a, b: fn(a, b).cast(kind))

        gathered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])  # CHUNK at most
        for fn in (step, combine):
            rows = rows.groupBy(F.expr(f"i div {CHUNK}").alias("k")).agg(gathered.alias("vs")).select(F.col("k").alias("i"), fold(F.col("vs"), fn).alias("v"))
        return rows.agg(gathered.alias("vs")).select(fold(F.col("vs"), combine)).first()[0]

    def collect(self, *how, value=None):
        """``collect(collector)``: its result over all rows. ``collect(zero, accumulate, combine)``: a mutable reduction, as Columns."""
        if len(how) > 1:
            return self.reduce(*how, value=value)
        return self.df.agg(how[0].aggregate(self._seen()).alias("v")).first()[0]

    def spliterator(self) -> Spliterator:
        return Spliterator(self)

    def _value(self, value) -> Column:
        seen = self._seen()
        if value is None:
            return seen if isinstance(seen, Column) else seen.as_struct()
        return seen[value] if isinstance(value, Field) else as_column(value(seen))


class Spliterator:
    """Traverses a stream, and can hand on a part of what is left before it begins. An ordered stream is not split."""

    def __init__(self, stream: Ordered, depth: int = 0):
        self._stream, self._depth, self._rows = stream, depth, None

    def try_split(self) -> Spliterator | None:
        """About half of the rows, by a hash; None once traversal has begun, or if the stream has an order."""
        if self._rows is not None or self._stream.order or self._depth >= 32:
            return None
        bit = F.shiftright("__h", self._depth).bitwiseAND(F.lit(1).cast("long"))
        df = self._stream.df.withColumn("__h", F.xxhash64(*self._stream._own()))
        other = self._stream._with(df.where(bit == 1).drop("__h"))
        self._stream = self._stream._with(df.where(bit == 0).drop("__h"))
        self._depth += 1
        return Spliterator(other, self._depth)

    def try_advance(self, fn: Callable) -> bool:
        if self._rows is None:
            self._rows = iter(self._stream.iterator())
        for row in self._rows:
            fn(row)
            return True
        return False

    def for_each_remaining(self, fn: Callable) -> None:
        while self.try_advance(fn):
            pass

    def estimate_size(self) -> int:
        """Of a part that has not been begun."""
        return self._stream.count()


class RecordStream(Ordered):
    def __init__(self, df: DataFrame, header: Header, order=()):
        self.df, self.header, self.order = df, header, list(order)

    @staticmethod
    def of(df: DataFrame, *fields: Field) -> RecordStream:
        """Fields are matched to the DataFrame's columns by place; without fields each column gets a new one of its name and type."""
        made = fields or tuple(Field(c) for c in df.columns)
        if len(made) != len(df.columns):
            raise ValueError(f"{len(made)} fields for {len(df.columns)} columns")
        return RecordStream(df.toDF(*[f.column for f in made]), Header(made))

    @staticmethod
    def aux(source) -> Aux:
        """Any DataFrame or stream as a plain stream; a record stream as a stream of structs."""
        if isinstance(source, Aux):
            return source
        if isinstance(source, RecordStream):
            return source.map(lambda r: r.as_struct())
        return Aux(source.select((F.col(source.columns[0]) if len(source.columns) == 1 else F.struct(*source.columns)).alias("value")))

    @staticmethod
    def concat(*streams: RecordStream) -> RecordStream:
        """All rows of all streams, which must have equal headers."""
        for s in streams[1:]:
            if s.header != streams[0].header:
                raise ValueError(f"headers differ: {streams[0].header} and {s.header}")
        df = streams[0]._plain()
        for s in streams[1:]:
            df = df.union(s._plain())
        return streams[0]._heir(RecordStream(df, streams[0].header), *streams[1:])

    def _with(self, df: DataFrame, order=None) -> RecordStream:
        return self._heir(RecordStream(df, self.header, self.order if order is None else order))

    def _own(self) -> list[str]:
        return [f.column for f in self.header]

    def _seen(self) -> Record:
        return Record(self.header)

    def field(self, name: str) -> Field:
        """The field of a display name."""
        found = [f for f in self.header if f.name == name]
        if len(found) != 1:
            raise KeyError(f"{len(found)} fields are named {name}")
        return found[0]

    def select(self, configure: Callable[[Select], None]) -> RecordStream:
        select = Select(self._seen())
        configure(select)
        windows = any(isinstance(d, Windowed) for d in select.defs.values())
        if windows:
            self._batch("a window function")
        df, header = select.apply(self.df, [] if windows else self._hidden())
        made = self._heir(RecordStream(df, header, [] if windows else self.order))
        made._few = self._few
        return made

    def aggregate(self, configure: Callable[[Aggregate], None]) -> RecordStream:
        aggregate = Aggregate(self._seen())
        configure(aggregate)
        return self._heir(RecordStream(*aggregate.apply(self._plain())))

    def _join(self, kind: str, right: RecordStream, on, select) -> RecordStream:
        if kind in ("right", "full"):
            self._batch(f"a {kind} join")
        return self._heir(RecordStream(*outer_join(kind, self._plain(), self.header, right._plain(), right.header, on, select)), right)

    def join(self, right: RecordStream, on, select) -> RecordStream:
        return self._join("inner", right, on, select)

    def left_join(self, right: RecordStream, on, select) -> RecordStream:
        return self._join("left", right, on, select)

    def right_join(self, right: RecordStream, on, select) -> RecordStream:
        return self._join("right", right, on, select)

    def full_join(self, right: RecordStream, on, select) -> RecordStream:
        return self._join("full", right, on, select)

    def _semi(self, kind: str, right: RecordStream, on) -> RecordStream:
        return self._heir(self._with(semi_join(kind, self.df, self.header, right._plain(), right.header, on)), right)

    def left_any_match(self, right: RecordStream, on) -> RecordStream:
        return self._semi("any", right, on)

    def left_none_match(self, right: RecordStream, on) -> RecordStream:
        return self._semi("none", right, on)

    def left_all_match(self, right: RecordStream, on) -> RecordStream:
        """Left records that match every right record; all of them if there is none."""
        return self._semi("all", right, on)

    def left_not_all_match(self, right: RecordStream, on) -> RecordStream:
        return self._semi("not_all", right, on)

    def _aux(self, column: Column) -> Aux:
        return self._heir(Aux(self.df.select(column.alias("value"), *self._hidden()), self.order))

    def map(self, fn) -> Aux:
        return self._aux(as_column(fn(self._seen())))

    def map_to_int(self, fn) -> Aux:
        return self._aux(as_column(fn(self._seen())).cast("int"))

    def map_to_long(self, fn) -> Aux:
        return self._aux(as_column(fn(self._seen())).cast("long"))

    def map_to_double(self, fn) -> Aux:
        return self._aux(as_column(fn(self._seen())).cast("double"))

    def flat_map(self, fn, kind: str | None = None) -> Aux:
        """``fn`` gives an array for each record; its elements follow one another."""
        column = F.explode(as_column(fn(self._seen())))
        out = self._heir(Aux(self.df.select(column.alias("value"), *self._hidden()), self.order))
        return out.cast(kind) if kind else out

    def flat_map_to_int(self, fn) -> Aux:
        return self.flat_map(fn, "int")

    def flat_map_to_long(self, fn) -> Aux:
        return self.flat_map(fn, "long")

    def flat_map_to_double(self, fn) -> Aux:
        return self.flat_map(fn, "double")

    def to_array(self) -> list:
        return self._rows().toDF(*[f.name for f in self.header]).collect()

    def to_df(self, names: Iterable[str] | None = None) -> DataFrame:
        """A DataFrame with display names, which must differ; sorted if the stream has an order."""
        names = list(names) if names is not None else [f.name for f in self.header]
        if len(set(names)) != len(names):
            raise ValueError(f"columns of the same name: {names}")
        return self._spread_rows().toDF(*names)

    def to_record_set(self):
        from .recordset import RecordSet

        return RecordSet(self)

    def write_parquet(self, path: str, *partition_by: str) -> None:
        self.to_df().write.partitionBy(*partition_by).parquet(path) if partition_by else self.to_df().write.parquet(path)


class Aux(Ordered):
    """A stream of values: one column. Primitive streams are those of a numeric type."""

    def __init__(self, df: DataFrame, order=()):
        self.df, self.order = df, list(order)

    @staticmethod
    def of(spark: SparkSession, values: Iterable, dtype: str) -> Aux:
        return Aux(spark.createDataFrame([(v,) for v in values], f"value {dtype}"))

    @staticmethod
    def range(spark: SparkSession, start: int, end: int, dtype: str = "int") -> Aux:
        """Half-open."""
        return Aux(spark.range(start, end).select(F.col("id").cast(dtype).alias("value"))).with_order()

    def _with(self, df: DataFrame, order=None) -> Aux:
        return self._heir(Aux(df, self.order if order is None else order))

    def _own(self) -> list[str]:
        return ["value"]

    def _seen(self) -> Column:
        return F.col("value")

    def map_to_record(self, configure: Callable[[Into], None]) -> RecordStream:
        into = Into(self._seen())
        configure(into)
        df, header = into.apply(self.df, self._hidden())
        return self._heir(RecordStream(df, header, self.order))

    def map(self, fn) -> Aux:
        return self._with(self.df.select(as_column(fn(self._seen())).alias("value"), *self._hidden()))

    def cast(self, dtype: str) -> Aux:
        return self.map(lambda v: v.cast(dtype))

    def map_to_int(self, fn=lambda v: v) -> Aux:
        return self.map(lambda v: as_column(fn(v)).cast("int"))

    def map_to_long(self, fn=lambda v: v) -> Aux:
        return self.map(lambda v: as_column(fn(v)).cast("long"))

    def map_to_double(self, fn=lambda v: v) -> Aux:
        return self.map(lambda v: as_column(fn(v)).cast("double"))

    map_to_obj = map

    def boxed(self) -> Aux:
        return self

    def as_long_stream(self) -> Aux:
        return self.cast("long")

    def as_double_stream(self) -> Aux:
        return self.cast("double")

    def flat_map(self, fn, kind: str | None = None) -> Aux:
        out = self._with(self.df.select(F.explode(as_column(fn(self._seen()))).alias("value"), *self._hidden()))
        return out.cast(kind) if kind else out

    def flat_map_to_int(self, fn) -> Aux:
        return self.flat_map(fn, "int")

    def flat_map_to_long(self, fn) -> Aux:
        return self.flat_map(fn, "long")

    def flat_map_to_double(self, fn) -> Aux:
        return self.flat_map(fn, "double")

    def to_array(self) -> list:
        return [r[0] for r in self._rows().collect()]

    def find_first(self):
        row = super().find_first()
        return None if row is None else row[0]

    def find_any(self):
        row = super().find_any()
        return None if row is None else row[0]

    def sum(self):
        """0 for no values."""
        return self.df.agg(F.coalesce(F.sum("value"), F.lit(0))).first()[0]

    def average(self):
        """None for no values."""
        return self.df.agg(F.avg("value")).first()[0]

    def summary_statistics(self):
        return self.statistics_df().first()

    def statistics_df(self) -> DataFrame:
        v = F.col("value")
        return self.df.agg(F.count(v).alias("count"), F.coalesce(F.sum(v), F.lit(0)).alias("sum"), F.coalesce(F.avg(v), F.lit(0.0)).alias("average"), F.min(v).alias("min"), F.max(v).alias("max"))

    def to_df(self) -> DataFrame:
        return self._spread_rows()
