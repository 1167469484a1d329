"""Further queries: plain streams, record sets, terminals, keyless windows, collectors, and range joins over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..field import Field
from ..functions import analytics as an
from ..functions import collectors as co
from ..functions import scalars as sc
from ..operators import recipes
from ..ordering import asc, desc
from ..recordset import RecordSet
from ..sources import doubles, int_range, long_range
from ..stream import RecordStream
from .queries import fields, query


def _spark(t):
    return t("region").df.sparkSession


def _one_row(t, schema: str, values: tuple):
    return _spark(t).createDataFrame([values], schema)


# --- plain streams, record sets ----------------------------------------------------------------------------------------


@query("SELECT CAST(i AS INTEGER) AS i, CAST(i * i AS INTEGER) AS square FROM range(0, 100) t(i) WHERE i % 3 = 0")
def aux_int_range(t):
    i, square = Field("i", "int"), Field("square", "int")
    return int_range(_spark(t), 0, 100).filter(lambda v: v % 3 == 0).map_to_record(lambda r: r.field(i, lambda v: v).field(square, lambda v: v * v))


@query("SELECT CAST(i AS BIGINT) AS i FROM range(5, 1005) t(i) WHERE i % 7 = 2 ORDER BY i DESC LIMIT 20 OFFSET 3")
def aux_long_range(t):
    """A plain stream that is sorted, skipped and limited."""
    values = long_range(_spark(t), 5, 1005).filter(lambda v: v % 7 == 2)
    return values.sorted(desc(lambda v: v)).skip(3).limit(20).map_to_record(lambda r: r.field(Field("i", "long"), lambda v: v))


@query("SELECT v, CAST(v * 2 AS BIGINT) AS twice FROM (VALUES (0.5::DOUBLE), (1.5), (-2.0), (4.25)) t(v)")
def aux_doubles(t):
    v, twice = Field("v", "double"), Field("twice", "long")
    return doubles(_spark(t), [0.5, 1.5, -2.0, 4.25]).map_to_record(lambda r: r.field(v, lambda x: x).field(twice, lambda x: (x * 2).cast("long")))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def aux_of_records(t):
    """Records as a plain stream of structs, and all their fields again."""
    s = t("nation")
    return RecordStream.aux(s).map_to_record(lambda i: s.header.select_all_fields(i))


@query("SELECT n_regionkey, count(*) AS n, CAST((SELECT count(*) FROM nation) AS BIGINT) AS size FROM nation GROUP BY 1")
def record_set_again(t):
    """A materialised set, read more than once."""
    s = t("nation")
    (region,) = fields(s, "n_regionkey")
    held = s.to_record_set()
    n, size = Field("n"), Field("size", "long")
    whole = held.size()
    return held.stream().aggregate(lambda a: a.key_field(region).agg_field(n, co.counting()).post_field(size, lambda _: F.lit(whole)))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(i AS VARCHAR) || '!' AS s FROM range(0, 30) t(i)")
def record_set_collector(t):
    i, text = Field("i", "int"), Field("s")
    collect = RecordSet.collector(lambda r: r.field(i, lambda v: v).field(text, lambda v: sc.text(v, "!")))
    return collect(int_range(_spark(t), 0, 30)).stream()


@query("SELECT vec_id, CAST(label AS BIGINT) * 2 AS twice, label + 1 AS next, CAST(label AS BIGINT) * 2 + 1 AS odd FROM embeddings")
def select_fields_parent(t):
    """Back from a shared intermediate to the projection it belongs to."""
    s = t("embeddings")
    key, label = fields(s, "vec_id", "label")
    twice, after, odd = Field("twice", "long"), Field("next", "int"), Field("odd", "long")
    return s.select(lambda o: o.field(key).fields(lambda r: r[label].cast("long") * 2, lambda f: f.field(twice, lambda v: v).parent.field(after, lambda r: r[label] + 1)).post_field(odd, lambda r: r[twice] + 1))


@query("SELECT CAST(CAST(floor(v * 10) AS BIGINT) AS DOUBLE) AS v, count(*) AS n FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1")
def flat_map_to_double(t):
    s = t("embeddings")
    (vector,) = fields(s, "embedding")
    v, n = Field("v", "double"), Field("n")
    tenths = s.flat_map_to_double(lambda r: F.transform(r[vector], lambda x: F.floor(x.cast("double") * 10)))
    return tenths.map_to_record(lambda i: i.field(v, lambda x: x)).aggregate(lambda a: a.key_field(v).agg_field(n, co.counting()))


@query("SELECT CAST(o_orderkey % 4 + k AS BIGINT) AS v, count(*) AS n FROM orders, range(0, 3) t(k) GROUP BY 1")
def flat_map_plain(t):
    """Of a plain stream: each value and its two successors."""
    s = t("orders")
    (key,) = fields(s, "o_orderkey")
    v = Field("v", "long")
    values = s.map_to_int(lambda r: r[key] % 4).flat_map_to_long(lambda x: F.sequence(x, x + 2))
    return values.map_to_record(lambda i: i.field(v, lambda x: x)).aggregate(lambda a: a.key_field(v).agg_field(Field("n"), co.counting()))


@query("SELECT CAST(w AS INTEGER) AS w, count(*) AS n FROM (SELECT length(unnest(string_split(p_name, ' '))) AS w FROM part) GROUP BY 1")
def flat_map_to_int(t):
    s = t("part")
    (name,) = fields(s, "p_name")
    w = Field("w", "int")
    lengths = s.flat_map_to_int(lambda r: F.transform(F.split(r[name], " "), lambda x: F.length(x)))
    return lengths.map_to_record(lambda i: i.field(w, lambda x: x)).aggregate(lambda a: a.key_field(w).agg_field(Field("n"), co.counting()))


@query("SELECT CAST(max(l_linenumber) AS BIGINT) AS hi, CAST(sum(l_linenumber) AS DOUBLE) / 2 AS halves FROM lineitem")
def aux_conversions(t):
    """To wider primitive streams and back to boxed values."""
    s = t("lineitem")
    (no,) = fields(s, "l_linenumber")
    numbers = s.map_to_int(lambda r: r[no])
    hi = numbers.as_long_stream().boxed().max()
    halves = numbers.as_double_stream().map_to_double(lambda v: v / 2).sum()
    return _one_row(t, "hi long, halves double", (hi, halves))


# --- order, sets ------------------------------------------------------------------------------------------------------


@query("SELECT n_regionkey, n_nationkey FROM nation ORDER BY n_regionkey, n_nationkey LIMIT 7")
def sorted_natural(t):
    """Without keys: by all columns in their order."""
    s = t("nation")
    return s.select(lambda o: o.fields(*fields(s, "n_regionkey", "n_nationkey"))).sorted().limit(7)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 1000")
def skip_alone(t):
    s = t("orders", "o_orderkey", "o_totalprice")
    key, price = fields(s, "o_orderkey", "o_totalprice")
    return s.sorted(desc(price), key).skip(1000)


@query("SELECT CAST(l_linenumber AS INTEGER) AS no FROM lineitem ORDER BY l_linenumber OFFSET 7001")
def skip_ties(t):
    """Rows that are all alike for most of the table: counted, not numbered."""
    s = t("lineitem", "l_linenumber")
    (no,) = fields(s, "l_linenumber")
    return s.sorted(no).skip(7000).skip(1).select(lambda o: o.field(Field("no", "int"), lambda r: r[no]))


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey + 20 FROM nation)")
def union_n_way(t):
    k = Field("k", "int")
    sides = []
    for table, column in (("customer", "c_nationkey"), ("supplier", "s_nationkey")):
        s = t(table)
        (f,) = fields(s, column)
        sides.append(s.select(lambda o, f=f: o.field(k, lambda r: r[f])))
    n = t("nation")
    (key,) = fields(n, "n_nationkey")
    return recipes.union_distinct(*sides, n.select(lambda o: o.field(k, lambda r: r[key] + 20)))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def peek_unordered(t):
    """Observed and no longer ordered: the rows are the same."""
    s = t("supplier")
    key, bal = fields(s, "s_suppkey", "s_acctbal")
    return s.sorted(desc(bal)).peek("seen").unordered().filter(lambda r: r[bal] > 0).select(lambda o: o.fields(key, bal))


# --- aggregation, collectors --------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS last FROM orders GROUP BY o_orderstatus, o_orderpriority")
def agg_hidden_keys(t):
    s = t("orders")
    status, prio, key = fields(s, "o_orderstatus", "o_orderpriority", "o_orderkey")
    return s.aggregate(lambda a: a.keys(status, prio).agg_field(Field("n"), co.counting()).agg_field(Field("last", "long"), co.maximum(key)))


@query("SELECT c_mktsegment, count(*) AS k FROM customer GROUP BY c_mktsegment")
def agg_key_redefined(t):
    """A key that is defined again as an aggregate is no key any more."""
    s = t("customer")
    seg, nation = fields(s, "c_mktsegment", "c_nationkey")
    k = Field("k")
    return s.aggregate(lambda a: a.key_field(seg).key_field(k, lambda r: r[nation]).agg_field(k, co.counting()))


@query("SELECT n_regionkey, string_agg(DISTINCT left(n_name, 1), '' ORDER BY left(n_name, 1)) AS initials, count(DISTINCT (n_nationkey % 2, n_regionkey)) AS kinds FROM nation GROUP BY 1")
def agg_sets(t):
    """A set of mapped values, and a set of records."""
    s = t("nation")
    region, name, key = fields(s, "n_regionkey", "n_name", "n_nationkey")
    initials = co.mapping(lambda r: F.left(r[name], F.lit(1)), co.to_set).and_then(lambda c: F.array_join(F.array_sort(c), ""))
    kinds = co.to_set(lambda r: F.struct((r[key] % 2).alias("odd"), r[region].alias("region"))).and_then(F.size)
    return s.aggregate(lambda a: a.key_field(region).agg_field(Field("initials"), initials).agg_field(Field("kinds", "long"), kinds))


@query("SELECT o_orderpriority, bit_xor(o_orderkey) AS mixed, CAST(sum(o_orderkey * o_orderkey) AS BIGINT) AS squares FROM orders GROUP BY 1")
def agg_custom(t):
    """Any aggregate of the engine, and a fold of one's own."""
    s = t("orders")
    prio, key = fields(s, "o_orderpriority", "o_orderkey")
    fold = co.folding(F.lit(0).cast("long"), lambda a, b: a + b * b, key)
    return s.aggregate(lambda a: a.key_field(prio).agg_field(Field("mixed"), co.custom(F.bit_xor, key)).agg_field(Field("squares"), fold))


# --- joins ----------------------------------------------------------------------------------------------------------


@query("SELECT r_regionkey, r_name, n_nationkey, n_name, n_regionkey FROM region LEFT JOIN nation ON r_regionkey = n_regionkey")
def join_all_fields(t):
    a, b = t("region"), t("nation")
    (rk,), (nr,) = fields(a, "r_regionkey"), fields(b, "n_regionkey")
    return a.left_join(b, lambda j: j.eq(j.left(rk), j.right(nr)), lambda s: s.left_all_fields().right_all_fields())


def _prices(t):
    c, o = t("customer", "c_custkey", "c_acctbal"), t("orders", "o_orderkey", "o_totalprice")
    ck, bal = fields(c, "c_custkey", "c_acctbal")
    ok, price = fields(o, "o_orderkey", "o_totalprice")
    near = lambda j: j.between(j.right(price), j.left(lambda r: r[bal] * 40), j.left(lambda r: r[bal] * 40 + 50))
    return c, o, ck, bal, ok, price, near, lambda s: s.left_field(ck).right_field(ok)


_NEAR = "o_totalprice BETWEEN c_acctbal * 40 AND c_acctbal * 40 + 50"


@query(f"SELECT c_custkey, o_orderkey FROM customer JOIN orders ON {_NEAR}")
def join_between_whole(t):
    c, o, *_, near, out = _prices(t)
    return c.join(o, near, out)


@query(f"SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON {_NEAR}")
def join_between_full(t):
    c, o, *_, near, out = _prices(t)
    return c.full_join(o, near, out)


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_acctbal > o_totalprice * 8")
def join_gt_whole(t):
    c, o, ck, bal, ok, price, _, out = _prices(t)
    return c.left_join(o, lambda j: j.gt(j.left(bal), j.right(lambda r: r[price] * 8)), out)


@query("SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN orders ON o_totalprice * 8 <= c_acctbal")
def join_lte_whole(t):
    c, o, ck, bal, ok, price, _, out = _prices(t)
    return c.right_join(o, lambda j: j.lte(j.right(lambda r: r[price] * 8), j.left(bal)), out)


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_orderkey OR c_acctbal > o_totalprice * 8")
def join_any_whole(t):
    c, o, ck, bal, ok, price, _, out = _prices(t)
    return c.join(o, lambda j: j.any(j.eq(j.left(ck), j.right(ok)), j.gt(j.left(bal), j.right(lambda r: r[price] * 8))), out)


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE {_NEAR})")
def semi_between_whole(t):
    c, o, ck, bal, ok, price, _, _ = _prices(t)
    return o.left_any_match(c, lambda j: j.between(j.left(price), j.right(lambda r: r[bal] * 40), j.right(lambda r: r[bal] * 40 + 50)))


@query(f"SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE {_NEAR})")
def semi_none_between_whole(t):
    """The kept side holds the intervals."""
    c, o, *_, near, _ = _prices(t)
    return c.left_none_match(o, near)


# --- windows ----------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place, count(*) OVER () AS n, max(s_acctbal) OVER () AS top FROM supplier")
def win_keyless(t):
    """Without keys all rows are one partition; aggregates of it are scalars."""
    s = t("supplier")
    key, bal = fields(s, "s_suppkey", "s_acctbal")
    place, n, top = Field("place"), Field("n"), Field("top")
    return s.select(lambda o: o.field(key).window(lambda w: w.field(place, [asc(bal), asc(key)], an.row_number()).field(n, an.from_agg(co.counting())).field(top, an.from_agg(co.maximum(bal)))))


@query(
    """SELECT c_custkey, rank() OVER w AS place, lead(c_custkey, 1, -1) OVER w AS after, percent_rank() OVER w AS share FROM customer
    WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)"""
)
def win_fields(t):
    """Several columns of one sort."""
    s = t("customer")
    key, nation, bal = fields(s, "c_custkey", "c_nationkey", "c_acctbal")
    place, after, share = Field("place"), Field("after"), Field("share")
    made = lambda c: c.field(place, an.rank()).field(after, an.link(key, 1, -1)).field(share, an.percent_rank())
    return s.select(lambda o: o.field(key).window(lambda w: w.keys(nation).fields([desc(bal), asc(key)], made)))


# --- terminals --------------------------------------------------------------------------------------------------------


@query(
    """SELECT count(*) AS n, min(s_acctbal) AS low, max(s_acctbal) AS high, bool_or(s_acctbal > 9000) AS some, bool_and(s_acctbal > 0) AS every, NOT bool_or(s_nationkey > 24) AS none,
    CAST(sum(s_suppkey) AS BIGINT) AS total, CAST(max(s_suppkey) AS BIGINT) AS top, CAST(sum(length(s_name)) AS BIGINT) AS letters, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS first FROM supplier"""
)
def terminals(t):
    """What ends a stream gives values; here they make a row."""
    s = t("supplier")
    key, name, nation, bal = fields(s, "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    by = s.sorted(bal, key)
    total = s.map_to_long(lambda r: r[key]).reduce(0, lambda a, b: a + b)
    top = s.reduce(lambda a, b: F.greatest(a, b), value=key)
    letters = s.collect(F.lit(0).cast("long"), lambda a, x: a + F.length(x), lambda a, b: a + b, value=name)
    low, high = s.min(bal)[s.header.index_of(bal)], s.max(bal)[s.header.index_of(bal)]
    found = (s.count(), low, high, s.any_match(lambda r: r[bal] > 9000), s.all_match(lambda r: r[bal] > 0), s.none_match(lambda r: r[nation] > 24), total, top, letters, by.find_first()[s.header.index_of(key)])
    return _one_row(t, "n long, low double, high double, some boolean, every boolean, none boolean, total long, top long, letters long, first long", found)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC LIMIT 9")
def terminals_of_rows(t):
    """Arrays, iterators, ordered visits and parts of a traversal see the same rows."""
    s = t("nation").select(lambda o: o.all_fields())
    key, name, region = s.header
    s = s.select(lambda o: o.fields(key, name)).sorted(desc(name)).limit(9)
    visited: list = []
    s.for_each_ordered(lambda r: visited.append(tuple(r)))
    walk, parts = s.unordered().spliterator(), []
    other = walk.try_split()
    for part in (walk, other):
        part.for_each_remaining(lambda r: parts.append(tuple(r)))
    rows = [tuple(r) for r in s.to_array()]
    if not rows == visited == [tuple(r) for r in s.iterator()] == sorted(parts, key=lambda r: r[1], reverse=True) or s.find_any() is None:
        raise AssertionError("terminals differ")
    return _spark(t).createDataFrame(rows, "n_nationkey int, n_name string")


@query("SELECT CAST(25 AS BIGINT) AS n, TRUE AS parallel, FALSE AS after_sequential, 'first,second' AS closed")
def stream_handling(t):
    """Kinds of execution, and handlers that run when a stream is closed."""
    s, said = t("nation"), []
    one = s.on_close(lambda: said.append("first")).filter(lambda _: F.lit(True)).on_close(lambda: said.append("second")).sequential()
    n = one.count()
    one.close()
    one.close()
    return _one_row(t, "n long, parallel boolean, after_sequential boolean, closed string", (n, s.is_parallel(), one.is_parallel(), ",".join(said)))
