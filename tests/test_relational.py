"""Literal expected tables for every feature, and brute force for the predicate algebra."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rowloom import Aux, Field, FieldCycleError, RecordSet, RecordStream, asc, desc, stream
from rowloom.functions import analytics as an
from rowloom.functions import collectors as co
from rowloom.functions import scalars as sc
from rowloom.operators import join, predicates, recipes
from rowloom.sources import doubles, int_range, rows

A, B, C, D = (Field(n, "int") for n in "ABCD")
L = Field("L", "long")
S = Field("S")


def got(stream, *by):
    return [tuple(r) for r in stream.sorted(*by).to_array()]


def ints(spark, a, b, fn=lambda i: i.field(A, lambda v: v)):
    return int_range(spark, a, b).map_to_record(fn)


def greetings(spark):
    left = ints(spark, 0, 10, lambda i: i.field(A, lambda v: v).field(S, lambda v: sc.text("Hello ", v))).filter(lambda r: r[A] > 2)
    right = ints(spark, 0, 10, lambda i: i.field(A, lambda v: v).field(S, lambda v: sc.text("Goodbye ", v))).filter(lambda r: r[A] < 8)
    return left, right


@pytest.mark.parametrize(("kind", "want"), [("join", range(3, 8)), ("left_join", range(3, 10)), ("right_join", range(8)), ("full_join", range(10))])
def test_simple_joins(spark, kind, want):
    left, right = greetings(spark)
    key = lambda a, b: F.when(a.is_nil(), b[A]).otherwise(a[A])
    out = getattr(left, kind)(right, lambda j: j.eq(j.left(A), j.right(A)), lambda s: s.field(A, key).field(S, lambda a, b: sc.text(a[S], " and ", b[S])))
    say = lambda word, i, there: f"{word} {i}" if there else "null"
    assert got(out) == [(i, f"{say('Hello', i, i > 2)} and {say('Goodbye', i, i < 8)}") for i in want]


def test_semi_joins_and_set_recipes(spark):
    left, right = greetings(spark)
    on = lambda j: j.eq(j.left(A), j.right(A))
    assert [r[0] for r in got(left.left_any_match(right, on))] == [3, 4, 5, 6, 7]
    assert [r[0] for r in got(left.left_none_match(right, on))] == [8, 9]
    one = rows(spark, [A], [(1,), (1,), (None,), (2,)])
    two = rows(spark, [A], [(1,), (None,), (3,)])
    assert got(recipes.intersect(one, two)) == [(None,), (1,), (1,)]
    assert got(recipes.except_(one, two)) == [(2,)]
    assert got(recipes.union_distinct(one, two)) == [(None,), (1,), (2,), (3,)]
    with pytest.raises(ValueError):
        RecordStream.concat(one, ints(spark, 0, 1, lambda i: i.field(B, lambda v: v)))


@pytest.mark.parametrize(("op", "n"), [("neq", 90), ("ceq", 10), ("cneq", 90), ("gt", 45), ("gte", 55), ("lt", 45), ("lte", 55)])
def test_operators_of_a_self_join(spark, op, n):
    s = ints(spark, 0, 10)
    assert s.join(s, lambda j: getattr(j, op)(j.left(A), j.right(A)), lambda o: o.left_field(A).field(B, lambda _, b: b[A])).count() == n


LOW = lambda v: -(10**9) if v is None else v
HOLDS = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "gt": lambda a, b: LOW(a) > LOW(b), "gte": lambda a, b: LOW(a) >= LOW(b), "lt": lambda a, b: LOW(a) < LOW(b), "lte": lambda a, b: LOW(a) <= LOW(b)}


@pytest.mark.parametrize("right", [[], [None], [None, 2, 4], [2], [1, 3, 3, 5]])
def test_predicates_against_brute_force(spark, right):
    """All operators, both operand orders, all quantifiers: one query, counted for each."""
    left = [(0, None), (1, None), (2, 1), (3, 2), (4, 3), (5, 5)]
    a, b = rows(spark, [A, B], left), rows(spark, [C], [(v,) for v in right])
    tag = Field("tag")
    parts, want = [], []
    for op, reverse in itertools.product(HOLDS, (False, True)):
        on = (lambda j, op=op: getattr(j, op)(j.right(C), j.left(B))) if reverse else (lambda j, op=op: getattr(j, op)(j.left(B), j.right(C)))
        hold = lambda x, y, op=op, reverse=reverse: HOLDS[op](y, x) if reverse else HOLDS[op](x, y)
        for kind, rule in (("any", any), ("none", lambda v: not any(v)), ("all", all), ("not_all", lambda v: not all(v))):
            name = f"{op} {reverse} {kind}"
            parts.append(getattr(a, f"left_{kind}_match")(b, on).select(lambda s, name=name: s.field(A).field(tag, lambda _: F.lit(name))))
            want += [(i, name) for i, x in left if rule([hold(x, y) for y in right])]
            if kind != "none":  # the general form must agree with the one by extremes
                general = lambda j, on=on: j.not_(j.not_(on(j)))
                parts.append(getattr(a, f"left_{kind}_match")(b, general).select(lambda s, name=name: s.field(A).field(tag, lambda _: F.lit("general " + name))))
                want += [(i, "general " + name) for i, x in left if rule([hold(x, y) for y in right])]
    assert got(RecordStream.concat(*parts)) == sorted(want)


def test_join_conditions(spark):
    s = ints(spark, 0, 5)
    pair = lambda o: o.left_field(A).field(B, lambda _, b: b[A])
    on = lambda j: j.any(j.between(j.left(A), j.right(lambda r: r[A] - 1), j.val(3)), j.all(j.eq(j.left(A), j.val(4)), j.eq(j.right(A), j.val(4))))
    want = [(x, y) for y in range(5) for x in range(5) if y - 1 <= x <= 3 or (x == 4 and y == 4)]
    assert got(s.right_join(s, on, pair)) == sorted(want) and len(want) == 15
    assert got(s.left_join(s, lambda j: j.lt(j.left(lambda r: r[A] + 5), j.eval(lambda: 7)), pair)) == [(x, y) for x in (0, 1) for y in range(5)] + [(x, None) for x in (2, 3, 4)]
    assert got(s.left_join(s, lambda j: j.lt(j.val(3), j.val(2)), pair)) == [(x, None) for x in range(5)]
    assert s.full_join(s, lambda j: j.eq(j.val(1), j.val(1)), pair).count() == 25
    assert s.join(s, lambda j: j.any(), pair).count() == 0 and s.join(s, lambda j: j.all(), pair).count() == 25
    assert got(s.right_join(s, lambda j: j.lt(j.val(3), j.right(A)), pair)) == [(None, y) for y in range(4)] + [(x, 4) for x in range(5)]


def test_eval_is_called_once(spark):
    calls = []
    s = ints(spark, 0, 3)
    s.left_any_match(s, lambda j: j.between(j.eval(lambda: calls.append(1) or 1), j.left(A), j.right(A))).count()
    assert len(calls) == 1


def test_join_output(spark):
    left = ints(spark, 0, 3, lambda i: i.field(A, lambda v: v).field(B, lambda v: v + 1).field(C, lambda v: v + 2))
    right = ints(spark, 0, 3, lambda i: i.field(A, lambda v: v).field(B, lambda v: v * 10))
    on = lambda j: j.eq(j.left(A), j.right(A))
    both = left.join(right, on, lambda s: s.left_all_fields().right_all_fields())
    assert list(both.header) == [A, B, C] and got(both) == [(0, 0, 2), (1, 10, 3), (2, 20, 4)]
    some = left.join(right, on, lambda s: s.left_all_fields_except(C).right_fields(A).fields(lambda a, b: a[C] + b[B], lambda f: f.field(C, lambda v: v).field(D, lambda v: v * 2)))
    assert got(some) == [(0, 1, 2, 4), (1, 2, 13, 26), (2, 3, 24, 48)]
    with pytest.raises(ValueError):
        left.join(right, on, lambda s: s.left_all_fields_except(C, C))


def test_select_keeps_places_and_shares(spark):
    s = ints(spark, 45, 48, lambda i: i.field(A, lambda v: v).field(B, lambda v: v + 1).field(D, lambda v: v + 3))
    out = s.select(lambda o: o.all_fields().field(B, lambda r: r[A] * 2).fields(lambda r: r[A] + r[D], lambda f: f.field(C, lambda v: v).field(A, lambda v: v - 1)))
    assert list(out.header) == [A, B, D, C]
    assert got(out) == [(92, 90, 48, 93), (94, 92, 49, 95), (96, 94, 50, 97)]
    assert got(s.select(lambda o: o.all_fields_except(B, C))) == [(45, 48), (46, 49), (47, 50)]
    with pytest.raises(KeyError):
        s.select(lambda o: o.field(C))
    pin = s.header.pin(B)
    assert got(s.select(lambda o: o.field(pin))) == [(46,), (47,), (48,)]
    with pytest.raises(KeyError):
        s.select(lambda o: o.all_fields_except(A)).select(lambda o: o.field(pin))


def test_post_fields(spark):
    s = ints(spark, 0, 3)
    out = s.select(lambda o: o.field(A).post_field(B, lambda r: r[A] + r[C]).post_field(C, lambda r: r[A] + r[D]).post_field(D, lambda _: F.lit(1)))
    assert got(out) == [(i, 2 * i + 1, i + 1, 1) for i in range(3)]
    with pytest.raises(FieldCycleError, match="B -> C -> B"):
        s.select(lambda o: o.post_field(B, lambda r: r[C]).post_field(C, lambda r: r[B]))


def test_equal_names_are_different_fields(spark):
    one, two = Field("x"), Field("x")
    s = ints(spark, 0, 2, lambda i: i.field(one, lambda v: v).field(two, lambda v: v + 1))
    assert got(s) == [(0, 1), (1, 2)]
    with pytest.raises(ValueError):
        s.to_df()
    assert s.to_df(["a", "b"]).columns == ["a", "b"]


def test_all_analytic_functions(spark):
    values = [1, 2, 3, 2, 4, 8, 4, 4, 5, 9]
    s = rows(spark, [A], [(v,) for v in values])
    out = [Field(n) for n in "no rank dense tile lead cume pct disc cont total same_rank same_dense same_cume same_pct".split()]
    tie = [A]
    fns = [an.row_number(), an.rank(0), an.dense_rank(1), an.n_tile(1, 3), an.link(A, 2, -1), an.cume_dist(), an.percent_rank(), an.percentile_disc(0.5, A), an.percentile_cont(0.5, A), an.from_agg(co.summing(A)), an.rank(0, tie), an.dense_rank(1, tie), an.cume_dist(tie), an.percent_rank(tie)]
    made = s.select(lambda o: o.field(A).window(lambda w: [w.field(f, [A], fn) for f, fn in zip(out, fns)]))
    v = sorted(values)
    got_rows = got(made)
    for i, (r, x) in enumerate(zip(got_rows, v)):
        less, upto = sum(y < x for y in v), sum(y <= x for y in v)
        assert r[0] == x and r[2] == less and r[3] == len({y for y in v if y <= x}) and r[4] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3][i]
        assert r[6] == upto / 10 and abs(r[7] - less / 9) < 1e-12 and r[8] == 4 and r[9] == 4.0 and r[10] == 42
        assert r[11:13] == r[2:4] and r[13] == r[6] and abs(r[14] - r[7]) < 1e-12
    assert sorted(r[1] for r in got_rows) == list(range(1, 11))
    assert sorted(r[5] for r in got_rows) == sorted(v[2:] + [-1, -1])
    with pytest.raises(ValueError):
        an.n_tile(1, 0)
    with pytest.raises(ValueError):
        an.percentile_disc(1.5, A)
    four = ints(spark, 1, 5).select(lambda o: o.window(lambda w: w.field(B, [A], an.percentile_disc(0.25, A)).field(C, [desc(A)], an.percentile_disc(0.25, A))))
    assert set(got(four)) == {(2, 3)}
    assert ints(spark, 0, 0).select(lambda o: o.window(lambda w: w.field(B, [A], an.row_number()))).count() == 0


def test_windows(spark):
    s = ints(spark, 46, 56, lambda i: i.field(A, lambda v: v).field(D, lambda v: sc.div(v, 10)))
    out = s.select(lambda o: o.all_fields().window(lambda w: w.keys(lambda r: sc.div(r[A], 10), lambda k: k.key(lambda v: v)).keys(D).field(B, an.from_agg(co.counting()))).window(lambda w: w.fields([desc(A)], lambda r: r[A], lambda f: f.field(C, lambda m: an.link(m, -1, 404)))))
    assert got(out) == [(i, i // 10, 4 if i < 50 else 6, i + 1 if i < 55 else 404) for i in range(46, 56)]


def test_pandas_analytics_give_one_or_n(spark):
    s = ints(spark, 0, 10, lambda i: i.field(A, lambda v: v).field(B, lambda v: v % 2))
    use = lambda fn: got(s.select(lambda o: o.fields(A).window(lambda w: w.key(B).field(C, [desc(A)], an.pandas_analytic(fn, "int")))))
    assert use(lambda f: [len(f)]) == [(i, 5) for i in range(10)]
    assert use(lambda f: range(len(f))) == [(i, (9 - i) // 2) for i in range(10)]
    with pytest.raises(Exception, match="4 values for 5 records"):
        use(lambda f: range(len(f) - 1))


def test_aggregate(spark):
    s = ints(spark, 0, 1000, lambda i: i.field(A, lambda v: v).field(C, lambda v: v + 2).field(D, lambda v: sc.div(v, 100)))
    n, total = Field("n"), Field("total")
    out = s.aggregate(lambda a: a.key_field(D).agg_field(total, co.summing(A)).agg_field(n, co.counting()))
    assert got(out) == [(k, 4950 + 10000 * k, 100) for k in range(10)]
    assert got(s.aggregate(lambda a: a.keys(D).agg_field(n, co.counting()))) == [(100,)] * 10
    one = s.aggregate(lambda a: a.aggs(co.summarizing(A), lambda g: g.agg_field(B, lambda v: v.max).agg_field(C, lambda v: v.min).agg_field(L, lambda v: v.sum).agg_field(total, lambda v: v.avg)))
    assert got(one) == [(999, 0, 499500, 499.5)]
    redefined = s.aggregate(lambda a: a.key_field(D).agg_field(D, co.counting()))  # the last key is gone
    assert got(redefined) == [(1000,)]
    empty = ints(spark, 5, 5)
    assert got(empty.aggregate(lambda a: a.agg_field(n, co.counting()).agg_field(total, co.summing(A)).agg_field(B, co.averaging(A)))) == [(0, 0, 0)]
    assert got(empty.aggregate(lambda a: a.key_field(A).agg_field(n, co.counting()))) == []
    folded = ints(spark, 1, 5).aggregate(lambda a: a.agg_field(L, co.folding(F.lit(1).cast("long"), lambda x, y: x * y, lambda r: r[A].cast("long"))))
    assert got(folded) == [(24,)]


def test_route(spark):
    s = ints(spark, 0, 100)
    big, twice, never, n = Field("big"), Field("twice"), Field("never"), Field("n")
    emit = lambda r: [(r[A] >= 90, big, r[A]), (r[A] < 10, twice, r[A]), (r[A] < 10, twice, -r[A]), (r[A] < 50, Field("unknown"), r[A])]
    children = lambda g: g.agg_field(big, co.summing()).agg_field(twice, co.counting()).agg_field(never, co.counting())
    assert got(s.aggregate(lambda a: a.route(emit, children).agg_field(n, co.counting()))) == [(945, 20, 0, 100)]
    by = s.aggregate(lambda a: a.key_field(D, lambda r: sc.div(r[A], 20)).route(emit, children).agg_field(n, co.counting()).post_field(C, lambda r: r[n] + r[twice]))
    assert got(by) == [(0, 0, 20, 0, 20, 40)] + [(k, 0, 0, 0, 20, 20) for k in (1, 2, 3)] + [(4, 945, 0, 0, 20, 20)]


def test_order_limit_take_drop(spark):
    s = rows(spark, [A, B], [(0, 1), (1, 2), (2, 9), (3, 1), (4, 3)]).with_order(A)
    small = lambda r: r[B] < 5
    assert [r.B for r in s.take_while(small).to_array()] == [1, 2]
    assert [r.B for r in s.drop_while(small).to_array()] == [9, 1, 3]
    assert s.take_while(lambda r: r[B] < 50).count() == 5 and s.drop_while(lambda r: r[B] < 50).count() == 0
    assert [r.A for r in s.skip(1).limit(2).to_array()] == [1, 2]
    assert [r.A for r in s.select(lambda o: o.field(A)).skip(3).to_array()] == [3, 4]
    assert s.find_first().asDict() and s.find_first()[0] == 0 and s.max(B)[0] == 2 and s.min(desc(A))[0] == 4
    for call in (lambda u: u.skip(1), lambda u: u.take_while(small), lambda u: u.find_first()):
        with pytest.raises(ValueError):
            call(s.unordered())
    t = rows(spark, [A], [(2,), (None,), (1,)])
    assert [r[0] for r in t.sorted(A).to_array()] == [None, 1, 2]
    assert [r[0] for r in t.sorted(desc(A)).to_array()] == [2, 1, None]
    assert [r[0] for r in t.sorted(asc(A, nulls_first=False)).to_array()] == [1, 2, None]
    f = rows(spark, [Field("d", "double")], [(float("nan"),), (0.0,), (-0.0,), (None,)])
    assert f.distinct().count() == 3


def test_record_sets(spark):
    make = RecordSet.collector(lambda i: i.field(A, lambda v: v).field(B, lambda v: v * 2))
    one, two, none = make(int_range(spark, 0, 100)), make(int_range(spark, 0, 100).parallel(4)), make(int_range(spark, 0, 0))
    assert one == two and one.size() == 100 and not one.is_empty()
    assert none.is_empty() and list(none.header) == [A, B] and none != one
    shown = RecordSet(rows(spark, [A, L, S], [(0, 22, "some"), (10, None, "test")]).with_order(A))
    assert str(shown) == "A  | L    | S\n0  | 22   | some\n10 | null | test"
    assert got(one.stream().filter(lambda r: r[A] < 2)) == [(0, 0), (1, 2)]


def test_plain_streams_and_terminals(spark):
    v = int_range(spark, 0, 10)
    assert v.sum() == 45 and v.average() == 4.5 and v.count() == 10 and v.find_first() == 0
    assert v.filter(lambda x: x > 6).to_array() == [7, 8, 9]
    assert v.reduce(0, lambda a, b: a + b) == 45 and v.collect(co.maximum()) == 9
    assert v.any_match(lambda x: x == 3) and not v.all_match(lambda x: x > 3) and v.none_match(lambda x: x > 30)
    assert v.flat_map(lambda x: F.sequence(F.lit(1), x)).count() == 1 * 1 + 1 + sum(range(1, 10))
    assert v.map_to_double(lambda x: x / 2).to_array()[3] == 1.5 and v.as_long_stream().boxed().df.dtypes == v.as_long_stream().df.dtypes
    assert doubles(spark, []).sum() == 0 and doubles(spark, []).average() is None
    assert int_range(spark, 0, 0).reduce(7, lambda a, b: a + b) == 7
    stats = v.summary_statistics()
    assert (stats["count"], stats["sum"], stats["min"], stats["max"], stats["average"]) == (10, 45, 0, 9, 4.5)
    s = ints(spark, 0, 4)
    assert s.map_to_int(lambda r: r[A] * 2).to_array() == [0, 2, 4, 6]
    assert s.flat_map_to_long(lambda r: F.array(r[A], r[A])).count() == 8
    assert [r[0] for r in s.iterator()] == [0, 1, 2, 3]
    assert RecordStream.aux(s).map(lambda v: v["A"]).to_array() == [0, 1, 2, 3]
    seen = []
    s.for_each_ordered(seen.append)
    assert len(seen) == 4 and Aux.of(spark, ["b", "a"], "string").sorted().to_array() == ["a", "b"]
    assert s.peek("seen").count() == 4


def test_recipes(spark):
    item, who = Field("item"), Field("who")
    done = rows(spark, [Field("w", "string"), Field("i", "string")], [("ann", "x"), ("ann", "y"), ("bob", "x"), ("cyd", "x"), ("cyd", "y"), ("cyd", "z")])
    done = done.select(lambda o: o.field(who, lambda r: r[done.header.fields[0]]).field(item, lambda r: r[done.header.fields[1]]))
    need = done.select(lambda o: o.field(item)).filter(lambda r: r[item] != "z").distinct()
    assert got(recipes.divide(done, who, item, need)) == [("ann",), ("cyd",)]
    assert got(recipes.divide(done, who, item, need.filter(lambda r: r[item] == "q"))) == [("ann",), ("bob",), ("cyd",)]
    staff, boss = Field("staff", "int"), Field("boss", "int")
    people = rows(spark, [staff, boss], [(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (11, 12), (12, 11)])
    start = people.filter(lambda r: r[boss].isNull())
    below = lambda level: level.join(people, lambda j: j.eq(j.left(staff), j.right(boss)), lambda s: s.right_all_fields())
    assert [r[0] for r in got(recipes.recursive(start, below))] == [1, 2, 3, 4, 5]
    with pytest.raises(RecursionError):
        recipes.recursive(people.filter(lambda r: r[staff] == 11), below, max_depth=4)
    cells = rows(spark, [A, B, C], [(1, 10, None)])
    assert got(recipes.unpivot(cells, [A], [B, C], S, D)) == [(1, "B", 10), (1, "C", None)]
    nested = Field("nested")
    assert [len(r[1]) for r in got(recipes.nest(ints(spark, 0, 6, lambda i: i.field(A, lambda v: v % 2).field(B, lambda v: v)), [A], nested), A)] == [3, 3]


def test_range_join_against_brute_force(spark):
    pts = [(1, 5), (2, 17), (3, -4), (4, None), (5, 30)]
    ivs = [(1, 0, 5), (2, 5, 31), (3, -9, -4), (4, 8, 3), (5, None, 40), (6, 17, 17)]
    p, lo, hi, left, right = Field("p", "int"), Field("lo", "int"), Field("hi", "int"), Field("left", "int"), Field("right", "int")
    out = recipes.range_join(rows(spark, [left, p], pts), rows(spark, [right, lo, hi], ivs), p, lo, hi, lambda s: s.left_field(left).right_field(right))
    want = sorted((i, k) for i, x in pts for k, a, b in ivs if None not in (x, a, b) and a <= x <= b)
    assert got(out) == want


def test_streams_refuse_what_needs_an_end(spark, tmp_path):
    from rowloom.streaming import parquet_stream

    spark.range(5).write.parquet(str(tmp_path / "t"))
    s = parquet_stream(spark, str(tmp_path / "t"), str(tmp_path / "t"))
    (key,) = s.header
    static = ints(spark, 0, 3)
    on = lambda j: j.eq(j.left(key), j.right(A))
    for call in (lambda: s.sorted(key), lambda: s.right_join(static, on, lambda o: o.left_all_fields()), lambda: s.full_join(static, on, lambda o: o.left_all_fields()), lambda: s.select(lambda o: o.window(lambda w: w.field(B, [key], an.row_number())))):
        with pytest.raises(TypeError):
            call()
    for kind, n in (("any", 3), ("none", 2), ("all", 0), ("not_all", 5)):
        q = getattr(s, f"left_{kind}_match")(static, on).to_df().writeStream.format("memory").queryName(f"m_{kind}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"m_{kind}").count() == n


NULLABLE = [None, None, -3, 0, 1, 1, 2, 5, 5, 9, 40]


def _low(v):
    return (v is not None, v or 0)


CONDITIONS = {
    "gt": (lambda j, x, a, b: j.gt(j.left(x), j.right(a)), lambda x, a, b: _low(x) > _low(a)),
    "lte reversed": (lambda j, x, a, b: j.lte(j.right(a), j.left(x)), lambda x, a, b: _low(a) <= _low(x)),
    "between": (lambda j, x, a, b: j.between(j.left(x), j.right(a), j.right(b)), lambda x, a, b: _low(a) <= _low(x) <= _low(b)),
    "between, other way": (lambda j, x, a, b: j.between(j.right(a), j.left(x), j.left(lambda r: r[x] + 3)), lambda x, a, b: _low(x) <= _low(a) <= _low(None if x is None else x + 3)),
    "two comparisons": (lambda j, x, a, b: j.all(j.gte(j.left(x), j.right(a)), j.lt(j.left(x), j.right(b))), lambda x, a, b: _low(a) <= _low(x) < _low(b)),
    "not": (lambda j, x, a, b: j.not_(j.lt(j.left(x), j.right(b))), lambda x, a, b: _low(x) >= _low(b)),
    "any": (lambda j, x, a, b: j.any(j.eq(j.left(x), j.right(a)), j.gt(j.left(x), j.right(b)), j.all(j.eq(j.left(x), j.val(1)), j.eq(j.right(b), j.val(2)))), lambda x, a, b: x == a or _low(x) > _low(b) or (x == 1 and b == 2)),
    "all of any": (lambda j, x, a, b: j.all(j.gte(j.right(b), j.val(1)), j.any(j.eq(j.left(x), j.right(a)), j.between(j.left(x), j.right(a), j.right(b)))), lambda x, a, b: _low(b) >= _low(1) and (x == a or _low(a) <= _low(x) <= _low(b))),
}


@pytest.mark.parametrize("name", CONDITIONS)
def test_indexed_joins_against_brute_force(spark, name):
    """Nulls, repeats, empty intervals; every kind of join; nothing compares all with all."""
    condition, holds = CONDITIONS[name]
    x, a, b, n, m = (Field(c, "int") for c in ("x", "a", "b", "n", "m"))
    left = list(enumerate(NULLABLE))
    right = [(i, NULLABLE[i % 11], NULLABLE[(3 * i + 1) % 11]) for i in range(14)]
    one, two = rows(spark, [n, x], left), rows(spark, [m, a, b], right)
    on = lambda j: condition(j, x, a, b)
    out = lambda s: s.left_field(n).right_field(m)
    pairs = [(i, k) for i, v in left for k, p, q in right if holds(v, p, q)]
    lone = [(i, None) for i, _ in left if i not in {i for i, _ in pairs}]
    alone = [(None, k) for k, _, _ in right if k not in {k for _, k in pairs}]
    for kind, want in (("join", pairs), ("left_join", pairs + lone), ("right_join", pairs + alone), ("full_join", pairs + lone + alone)):
        got = getattr(one, kind)(two, on, out)
        assert sorted(map(str, map(tuple, got.to_array()))) == sorted(map(str, want)), kind
        if kind == "join" and name not in ("any", "all of any"):
            plan = got.df._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    met = {i for i, _ in pairs}
    every = {i for i, v in left if all(holds(v, p, q) for _, p, q in right)}
    for kind, want in (("left_any_match", met), ("left_none_match", {i for i, _ in left} - met), ("left_all_match", every), ("left_not_all_match", {i for i, _ in left} - every)):
        assert sorted(r[0] for r in getattr(one, kind)(two, on).to_array()) == sorted(want), kind
    none = two.filter(lambda r: r[m] < 0)
    assert one.join(none, on, out).to_array() == [] and len(one.left_join(none, on, out).to_array()) == 11 and len(none.right_join(one, lambda j: j.gt(j.left(a), j.right(x)), lambda s: s.right_field(n)).to_array()) == 11


def test_skip_against_brute_force(spark):
    """Ties, nulls, equal rows, more than there is; plans never bring the table into one task."""
    values = [(v, i % 3) for i, v in enumerate(NULLABLE * 3)] + [(5, 1)] * 20
    s = rows(spark, [A, B], values)
    order = sorted((v for v, _ in values), key=_low, reverse=True)
    for n in (0, 1, 5, 17, 30, len(values), 99):
        left = s.sorted(desc(A)).skip(n)
        assert [r[0] for r in left.to_array()] == order[n:]
        assert [r[0] for r in left.limit(4).to_array()] == order[n : n + 4]
        assert [r[0] for r in left.skip(2).to_array()] == order[n + 2 :]
        assert left.filter(lambda r: r[A].isNull()).count() == sum(v is None for v in order[n:])
    plan = s.sorted(A).skip(5).limit(3).df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "SinglePartition" not in plan
    with pytest.raises(ValueError):
        s.skip(1)


def test_reductions(spark):
    numbers = int_range(spark, 0, 5000)
    assert numbers.reduce(lambda a, b: a + b) == 12497500 and numbers.reduce(0, lambda a, b: a + b) == 12497500
    assert numbers.filter(lambda v: v < 0).reduce(lambda a, b: a + b) is None and numbers.filter(lambda v: v < 0).reduce(7, lambda a, b: a + b) == 7
    text = numbers.reduce(F.lit(""), lambda a, v: F.concat(a, v.cast("string")), lambda a, b: F.concat(a, b))
    assert text == "".join(map(str, range(5000)))  # in the encounter order
    assert numbers.collect(F.lit(0).cast("long"), lambda a, v: a + v % 2, lambda a, b: a + b) == 2500


def test_handlers_flags_and_spliterators(spark):
    said = []
    s = ints(spark, 0, 100).on_close(lambda: said.append(1))

    def fails():
        said.append(2)
        raise RuntimeError("no")

    t = s.unordered().on_close(fails).on_close(lambda: said.append(3)).filter(lambda r: r[A] > 3)
    joined = t.join(ints(spark, 0, 9), lambda j: j.eq(j.left(A), j.right(A)), lambda o: o.left_field(A))
    with pytest.raises(RuntimeError):
        joined.close()
    assert said == [1, 2, 3] and joined.close() is None
    assert t.is_parallel() and not t.sequential().map(lambda r: r[A]).is_parallel() and t.sequential().parallel().is_parallel()
    whole = s.unordered().spliterator()
    parts = [whole, whole.try_split(), whole.try_split()]
    seen = []
    assert sum(p.estimate_size() for p in parts) == 100
    for p in parts:
        p.for_each_remaining(lambda r: seen.append(r[0]))
    assert sorted(seen) == list(range(100)) and whole.try_split() is None and s.spliterator().try_split() is None
    assert int_range(spark, 0, 3).flat_map_to_double(lambda v: F.array(v, v + 1)).to_array() == [0.0, 1.0, 1.0, 2.0, 2.0, 3.0]
    a, b = ints(spark, 0, 5).to_record_set(), ints(spark, 0, 5).to_record_set()
    assert a == b and hash(a) == hash(b) and len({a, b}) == 1


def _ranges(spark, monkeypatch):
    """Many narrow and wide intervals, nulls, frequent values; ranges of about four rows."""
    monkeypatch.setattr(join, "RANGE_ROWS", 4)
    draw = random.Random(5)
    some = lambda n: None if draw.random() < 0.1 else float(draw.choice([7, 7, 30, draw.randrange(n)]))
    x, a, b, n, m = Field("x", "double"), Field("a", "double"), Field("b", "double"), Field("n", "int"), Field("m", "int")
    left = [(i, some(60)) for i in range(90)]
    right = [(i, low, low + draw.choice([-1, 0, 1, 2, 40]) if low is not None and draw.random() < 0.9 else None) for i in range(70) for low in [some(90)]]
    return left, right, rows(spark, [n, x], left), rows(spark, [m, a, b], right), (x, a, b, n, m)


def _kinds(one, two, on, left, right, n, m, holds):
    pairs = [(i, k) for i, v in left for k, p, q in right if holds(v, p, q)]
    lone = [(i, None) for i in {i for i, _ in left} - {i for i, _ in pairs}]
    alone = [(None, k) for k in {k for k, *_ in right} - {k for _, k in pairs}]
    assert sorted(map(str, map(tuple, one.full_join(two, on, lambda s: s.left_field(n).right_field(m)).to_array()))) == sorted(map(str, pairs + lone + alone))
    assert {r[0] for r in one.left_any_match(two, on).to_array()} == {i for i, _ in pairs}


def test_narrow_ranges_against_brute_force(spark, monkeypatch):
    left, right, one, two, (x, a, b, n, m) = _ranges(spark, monkeypatch)
    _kinds(one, two, lambda j: j.between(j.left(x), j.right(a), j.right(b)), left, right, n, m, lambda v, p, q: _low(p) <= _low(v) <= _low(q))
    for op, holds in (("gt", lambda v, p, q: _low(v) > _low(p)), ("gte", lambda v, p, q: _low(v) >= _low(p)), ("lt", lambda v, p, q: _low(v) < _low(p)), ("lte", lambda v, p, q: _low(v) <= _low(p))):
        _kinds(one, two, lambda j, op=op: getattr(j, op)(j.left(x), j.right(a)), left, right, n, m, holds)


def test_intervals_meet_few_points_in_vain(spark):
    points, intervals = spark.range(400_000).toDF("x"), spark.range(0, 400_000, 800).toDF("low")
    pred = predicates.Pred(F.lit(True), search=predicates.Interval(predicates.LEFT, F.col("x"), F.col("low"), F.col("low") + 5))
    n = join.met(points, intervals, pred, predicates.LEFT, "inner").count()  # the ranges alone
    assert 500 * 6 <= n < 500 * 3 * 1024


def test_comparisons_that_nothing_meets(spark):
    left, right = spark.range(100_000).toDF("x"), spark.range(100_000, 100_050).toDF("y")
    pred = predicates.Pred(F.lit(True), search=("gt", F.col("x"), F.col("y")))
    assert join.met(left, right, pred, predicates.LEFT, "inner").count() == 0  # the ranges alone
    top = spark.range(2000).select(F.lit(99_999).alias("y"))
    assert join.met(left, top, pred, predicates.LEFT, "inner").count() == 0


def test_ranges_of_one_file_are_joined_in_many_tasks(spark):
    points, held = spark.range(0, 5000, 1, 1).select(F.col("id").alias("x")), spark.range(0, 50, 1, 1).select(F.col("id").alias("low"))
    pred = predicates.Pred(F.col("x").between(F.col("low"), F.col("low") + 9), search=predicates.Interval(predicates.LEFT, F.col("x"), F.col("low"), F.col("low") + 9))
    made = join.met(points, held, pred, predicates.LEFT, "inner")
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and made.count() == 500


def test_intervals_and_points_alone_are_not_paired(spark):
    """Whether there is a partner is settled without gathering partners, and without a copy in each range that an interval crosses."""
    x, a, b = Field("x", "int"), Field("a", "int"), Field("b", "int")
    points = ints(spark, 0, 3000, lambda i: i.field(x, lambda v: v * 2))
    held = ints(spark, 0, 3000, lambda i: i.field(a, lambda v: v * 2 + 1).field(b, lambda v: v * 2 + 1 + F.when(v % 10 == 0, 5000).otherwise(0)))
    lone = held.left_none_match(points, lambda j: j.between(j.right(x), j.left(a), j.left(b)))
    lost = points.left_none_match(held, lambda j: j.between(j.left(x), j.right(a), j.right(b)))
    for stream in (lone, lost):
        plan = stream.df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner" not in plan and "explode(sequence" not in plan
    assert lone.count() == 2700 and [r[0] for r in lost.to_array()] == [0]


def test_rows_that_tie_are_made_and_sorted_in_many_tasks(spark, monkeypatch):
    s = RecordStream.of(spark.range(0, 40_000, 1, 8).select((F.col("id") % 40_000 < 100).cast("int")), A).sorted(A)
    sizes = [len(p) for p in s.to_df().rdd.glom().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 25_000
    plan = s.to_df()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1
    monkeypatch.setattr(stream, "PIECE", 1000)
    left = s.skip(7000).skip(1)
    assert [r[0] for r in left.to_df().collect()] == [0] * (39_900 - 7001) + [1] * 100
    assert max(len(p) for p in left.df.rdd.glom().collect()) < 20_000  # before the sort
    some = rows(spark, [A, B], [(v, i % 3) for i, v in enumerate(NULLABLE * 3)]).sorted(desc(B), A)
    assert [tuple(r) for r in some.to_df().collect()] == [tuple(r) for r in some.to_array()]
