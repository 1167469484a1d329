"""Queries over the driver's tables, one or more for each operator, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..field import Field
from ..functions import analytics as an
from ..functions import collectors as co
from ..functions import scalars as sc
from ..operators import recipes
from ..ordering import asc, desc
from ..sources import parquet
from ..storage import shared_folder
from ..stream import RecordStream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(lambda name, *columns: parquet(spark, f"{sf_dir}/{name}.parquet", *columns))
            return out.to_df() if isinstance(out, RecordStream) else out

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = run, sql
        return fn

    return register


def fields(stream: RecordStream, *names: str) -> list[Field]:
    return [stream.field(n) for n in names]


# --- projection, filter ---------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice * (1 - l_discount), 4) AS net, l_linenumber // 2 AS half, l_returnflag || '/' || l_linestatus AS tag FROM lineitem")
def select_expr(t):
    s = t("lineitem")
    price, disc, no, flag, status = fields(s, "l_extendedprice", "l_discount", "l_linenumber", "l_returnflag", "l_linestatus")
    net, half, tag = Field("net"), Field("half", "long"), Field("tag")
    return s.select(
        lambda o: o.fields(*fields(s, "l_orderkey", "l_linenumber", "l_quantity"))
        .field(net, lambda r: F.round(r[price] * (1 - r[disc]), 4))
        .field(half, lambda r: sc.div(r[no], 2))
        .field(tag, lambda r: sc.text(r[flag], "/", r[status]))
    )


@query("SELECT o_orderkey, o_custkey + o_orderkey + 1 + 1 AS a, o_orderkey + 1 + 1 AS b, o_orderkey + 1 AS c FROM orders")
def select_post_fields(t):
    """Post-fields that need later ones."""
    s = t("orders")
    key, cust = fields(s, "o_orderkey", "o_custkey")
    a, b, c, hold = Field("a"), Field("b"), Field("c"), Field("hold")
    out = s.select(lambda o: o.field(key).post_field(a, lambda r: r[b] + r[hold]).post_field(b, lambda r: r[c] + 1).post_field(c, lambda r: r[key] + 1).field(hold, lambda r: r[cust]))
    return out.select(lambda o: o.all_fields_except(hold))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(year(o_orderdate) AS INT) * 100 + CAST(month(o_orderdate) AS INT) AS ym FROM orders")
def select_shared_intermediate(t):
    s = t("orders")
    key, date = fields(s, "o_orderkey", "o_orderdate")
    y, m, ym = Field("y", "int"), Field("m", "int"), Field("ym", "int")
    split = lambda r: F.struct(F.year(r[date]).alias("y"), F.month(r[date]).alias("m"))
    return s.select(lambda o: o.field(key).fields(split, lambda f: f.field(y, lambda v: v.y).field(m, lambda v: v.m).field(ym, lambda v: v.y * 100 + v.m)))


@query("SELECT s_suppkey, upper(s_name) AS s_name, s_nationkey + 1 AS s_nationkey, s_acctbal FROM supplier")
def select_redefine_position(t):
    s = t("supplier")
    name, nation = fields(s, "s_name", "s_nationkey")
    return s.select(lambda o: o.all_fields().field(name, lambda r: F.upper(r[name])).field(nation, lambda r: r[nation] + 1))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def filter_where(t):
    s = t("lineitem")
    ship, disc, qty = fields(s, "l_shipdate", "l_discount", "l_quantity")
    kept = s.filter(lambda r: (r[ship] >= F.lit("1995-01-01").cast("timestamp_ntz")) & r[disc].between(0.05, 0.07) & (r[qty] < 24))
    return kept.select(lambda o: o.fields(*fields(s, "l_orderkey", "l_partkey", "l_quantity")))


# --- order, limit, distinct, sets -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def sort_limit_offset(t):
    s = t("orders", "o_orderkey", "o_totalprice")
    key, price = fields(s, "o_orderkey", "o_totalprice")
    return s.sorted(desc(price), key).skip(5).limit(10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk(t):
    s = t("orders", "o_orderkey", "o_totalprice")
    key, price = fields(s, "o_orderkey", "o_totalprice")
    return recipes.top(s, 100, desc(price), asc(key))


@query("SELECT o_orderkey, nullif(o_custkey % 50, 0) AS k FROM orders ORDER BY k ASC NULLS FIRST, o_orderkey DESC")
def sorted_nulls_lowest(t):
    s = t("orders")
    key, cust = fields(s, "o_orderkey", "o_custkey")
    k = Field("k")
    out = s.select(lambda o: o.field(key).field(k, lambda r: F.nullif(r[cust] % 50, F.lit(0))))
    return out.sorted(k, desc(key))


_FAILS = "(event_type = 'signup' AND value >= 20)"


def _events_in_order(t):
    s = t("events", "event_id", "ts", "event_type", "value")
    ts, key, kind, value = fields(s, "ts", "event_id", "event_type", "value")
    return s.sorted(ts, key), lambda r: ~((r[kind] == "signup") & (r[value] >= 20))


@query(f"SELECT event_id, ts, event_type, value FROM (SELECT *, sum(CASE WHEN {_FAILS} THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events) WHERE n = 0")
def take_while(t):
    s, holds = _events_in_order(t)
    return s.take_while(holds)


@query(f"SELECT event_id, ts, event_type, value FROM (SELECT *, sum(CASE WHEN {_FAILS} THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events) WHERE n > 0")
def drop_while(t):
    s, holds = _events_in_order(t)
    return s.drop_while(holds)


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_keys(t):
    s = t("customer")
    return s.aggregate(lambda a: a.key_fields(*fields(s, "c_nationkey", "c_mktsegment")))


@query("SELECT DISTINCT nullif(l_linenumber, 3) AS n, l_returnflag FROM lineitem")
def distinct_rows(t):
    s = t("lineitem")
    no, flag = fields(s, "l_linenumber", "l_returnflag")
    return s.select(lambda o: o.field(Field("n"), lambda r: F.nullif(r[no], F.lit(3))).field(flag)).distinct()


def _nation_keys(t):
    """Keys of which each side has some that the other lacks, and nulls."""
    c, s = t("customer"), t("supplier")
    k = Field("k", "int")
    (a,), (b,) = fields(c, "c_nationkey"), fields(s, "s_nationkey")
    return c.select(lambda o: o.field(k, lambda r: F.nullif(r[a], F.lit(4)))), s.select(lambda o: o.field(k, lambda r: F.nullif(r[b] + 10, F.lit(14))))


_LEFT = "SELECT nullif(c_nationkey, 4) AS k FROM customer"
_RIGHT = "SELECT nullif(s_nationkey + 10, 14) AS k FROM supplier"


@query(f"{_LEFT} UNION ALL {_RIGHT}")
def concat_union_all(t):
    return RecordStream.concat(*_nation_keys(t))


@query(f"{_LEFT} UNION {_RIGHT}")
def union_distinct(t):
    return recipes.union_distinct(*_nation_keys(t))


@query(f"SELECT k FROM ({_LEFT}) a WHERE EXISTS (SELECT 1 FROM ({_RIGHT}) b WHERE a.k IS NOT DISTINCT FROM b.k)")
def intersect_semi(t):
    return recipes.intersect(*_nation_keys(t))


@query(f"SELECT k FROM ({_LEFT}) a WHERE NOT EXISTS (SELECT 1 FROM ({_RIGHT}) b WHERE a.k IS NOT DISTINCT FROM b.k)")
def except_anti(t):
    return recipes.except_(*_nation_keys(t))


# --- aggregation ----------------------------------------------------------------------------------------------------


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
)
def agg_pricing_summary(t):
    s = t("lineitem")
    flag, status, qty, price, disc, ship = fields(s, "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    two = lambda c: F.round(c, 2)
    kept = s.filter(lambda r: r[ship] <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return kept.aggregate(
        lambda a: a.key_fields(flag, status)
        .agg_field(Field("sum_qty"), co.summing(qty).and_then(two))
        .agg_field(Field("sum_base"), co.summing(price).and_then(two))
        .agg_field(Field("sum_disc"), co.summing(lambda r: r[price] * (1 - r[disc])).and_then(two))
        .agg_field(Field("avg_qty"), co.averaging(qty).and_then(lambda c: F.round(c, 6)))
        .agg_field(Field("n"), co.counting())
    )


def _global(s):
    no, qty = fields(s, "l_linenumber", "l_quantity")
    return s.aggregate(lambda a: a.agg_field(Field("n"), co.counting()).agg_field(Field("total", "long"), co.summing(no)).agg_field(Field("mean"), co.averaging(qty).and_then(lambda c: F.round(c, 6))))


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, round(avg(l_quantity), 6) AS mean FROM lineitem")
def agg_global(t):
    return _global(t("lineitem"))


@query("SELECT count(*) AS n, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS total, coalesce(round(avg(l_quantity), 6), 0.0) AS mean FROM lineitem WHERE l_quantity < 0")
def agg_global_empty(t):
    """One row even for no input, with sum 0 and mean 0."""
    s = t("lineitem")
    (qty,) = fields(s, "l_quantity")
    return _global(s.filter(lambda r: r[qty] < 0))


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY l_suppkey HAVING count(*) > 550")
def agg_grouped_having(t):
    s = t("lineitem")
    supp, price = fields(s, "l_suppkey", "l_extendedprice")
    n, revenue = Field("n"), Field("revenue")
    out = s.aggregate(lambda a: a.key_field(supp).agg_field(n, co.counting()).agg_field(revenue, co.summing(price).and_then(lambda c: F.round(c, 2))))
    return out.filter(lambda r: r[n] > 550)


@query("SELECT y, n FROM (SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def agg_temp_key(t):
    """The priority is a hidden key: its groups stay apart."""
    s = t("orders")
    date, prio = fields(s, "o_orderdate", "o_orderpriority")
    return s.aggregate(lambda a: a.key(prio).key_field(Field("y", "long"), lambda r: F.year(r[date])).agg_field(Field("n"), co.counting()))


@query(
    """SELECT CAST(l_suppkey % 10 AS BIGINT) AS bucket, CAST(max(l_linenumber) AS BIGINT) AS hi, CAST(min(l_linenumber) AS BIGINT) AS lo, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, round(avg(l_linenumber), 6) AS mean
    FROM lineitem GROUP BY 1"""
)
def agg_shared_stats(t):
    """Five columns of one accumulation, keys of one intermediate."""
    s = t("lineitem")
    no, supp = fields(s, "l_linenumber", "l_suppkey")
    hi, lo, n, total, mean = Field("hi", "long"), Field("lo", "long"), Field("n"), Field("total", "long"), Field("mean")
    parts = lambda g: g.agg_field(hi, lambda v: v.max).agg_field(lo, lambda v: v.min).agg_field(n, lambda v: v["count"]).agg_field(total, lambda v: v.sum).agg_field(mean, lambda v: F.round(v.avg, 6))
    return s.aggregate(lambda a: a.keys(lambda r: r[supp] % 10, lambda k: k.key_field(Field("bucket", "long"), lambda v: v)).aggs(co.summarizing(no), parts))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS total FROM orders GROUP BY o_orderpriority")
def agg_distinct(t):
    s = t("orders")
    prio, cust = fields(s, "o_orderpriority", "o_custkey")
    return s.aggregate(lambda a: a.key_field(prio).agg_field(Field("customers"), co.counting_distinct(cust)).agg_field(Field("total", "long"), co.summing_distinct(cust)))


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS total, round(sum(c_nationkey) / count(*), 6) AS ratio FROM customer GROUP BY c_mktsegment")
def agg_post_field(t):
    s = t("customer")
    seg, nation = fields(s, "c_mktsegment", "c_nationkey")
    n, total, ratio = Field("n"), Field("total", "long"), Field("ratio")
    return s.aggregate(lambda a: a.key_field(seg).post_field(ratio, lambda r: F.round(r[total] / r[n], 6)).agg_field(n, co.counting()).agg_field(total, co.summing(nation)))


@query("SELECT c_nationkey, string_agg(c_mktsegment || '=' || n, ',' ORDER BY c_mktsegment) AS entries FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def agg_to_map_entries(t):
    """A map for each group: an aggregation for its entries, another to gather them."""
    s = t("customer")
    nation, seg = fields(s, "c_nationkey", "c_mktsegment")
    n = Field("n")
    entries = s.aggregate(lambda a: a.key_fields(nation, seg).agg_field(n, co.counting()))
    shown = co.to_list(lambda r: sc.text(r[seg], "=", r[n])).and_then(lambda c: F.array_join(F.array_sort(c), ","))
    return entries.aggregate(lambda a: a.key_field(nation).agg_field(Field("entries"), shown))


@query("SELECT l_suppkey, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS q_open, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS q_final, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def route_pivot(t):
    """Each target is fed once a record at most: conditional aggregates in one pass, no row is multiplied."""
    s = t("lineitem")
    supp, qty, status, flag = fields(s, "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag")
    q_open, q_final, returned = Field("q_open"), Field("q_final"), Field("returned")
    emit = lambda r: [(r[status] == "O", q_open, r[qty]), (r[status] == "F", q_final, r[qty]), (r[flag] == "R", returned, F.lit(1))]
    two = co.summing().and_then(lambda c: F.round(c, 2))
    return s.aggregate(lambda a: a.key_field(supp).route(emit, lambda g: g.agg_field(q_open, two).agg_field(q_final, two).agg_field(returned, co.counting())).agg_field(Field("n"), co.counting()))


@query(
    """SELECT event_type, count(*) AS n, CAST(sum(1 + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fed, CAST(sum(event_id + CASE WHEN user_id % 2 = 0 THEN user_id ELSE 0 END) AS BIGINT) AS total, CAST(0 AS BIGINT) AS unfed
    FROM events GROUP BY event_type"""
)
def route_multi_emit(t):
    """Up to two emissions of a record to one target; a target that nothing feeds; other aggregates are not multiplied."""
    s = t("events")
    kind, key, user = fields(s, "event_type", "event_id", "user_id")
    fed, total, unfed = Field("fed"), Field("total", "long"), Field("unfed")
    emit = lambda r: [(True, fed, r[key]), (r[user] % 2 == 0, fed, r[user]), (True, total, r[key]), (r[user] % 2 == 0, total, r[user]), (True, Field("other"), r[key])]
    return s.aggregate(lambda a: a.key_field(kind).agg_field(Field("n"), co.counting()).route(emit, lambda g: g.agg_field(fed, co.counting()).agg_field(total, co.summing()).agg_field(unfed, co.counting())))


@query("SELECT l_orderkey, l_partkey, 'l_quantity' AS name, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'l_tax', nullif(l_tax, 0) FROM lineitem")
def unpivot(t):
    s = t("lineitem")
    (tax,) = fields(s, "l_tax")
    s = s.select(lambda o: o.all_fields().field(tax, lambda r: F.nullif(r[tax], F.lit(0.0))))
    return recipes.unpivot(s, fields(s, "l_orderkey", "l_partkey"), fields(s, "l_quantity", "l_tax"), Field("name"), Field("value"))


# --- joins ----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, l_quantity, o_custkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def join_inner_eq(t):
    a, b = t("lineitem"), t("orders")
    (lo,), (oo, status) = fields(a, "l_orderkey"), fields(b, "o_orderkey", "o_orderstatus")
    keys = lambda s: s.left_fields(*fields(a, "l_orderkey", "l_partkey", "l_quantity")).right_fields(*fields(b, "o_custkey", "o_totalprice"))
    return a.join(b.filter(lambda r: r[status] == "F"), lambda j: j.eq(j.left(lo), j.right(oo)), keys)


def _customers_orders(t):
    c, o = t("customer"), t("orders")
    ck, seg = fields(c, "c_custkey", "c_mktsegment")
    ok, oc, prio = fields(o, "o_orderkey", "o_custkey", "o_orderpriority")
    shifted = o.select(lambda x: x.all_fields().field(oc, lambda r: F.nullif(r[oc] * 2, F.lit(20))))  # orders without a customer, and customers without orders
    return c, shifted, ck, seg, ok, oc, prio


_CUST, _ORD = "customer", "(SELECT * REPLACE (nullif(o_custkey * 2, 20) AS o_custkey) FROM orders)"


def _outer(t, kind):
    c, o, ck, seg, ok, oc, _ = _customers_orders(t)
    state = lambda a, b: F.when(a.is_nil(), "no customer").when(b.is_nil(), "no order").otherwise("both")
    return getattr(c, kind)(o, lambda j: j.eq(j.left(ck), j.right(oc)), lambda s: s.left_fields(ck, seg).right_field(ok).field(Field("state"), state))


_STATE = "SELECT c_custkey, c_mktsegment, o_orderkey, CASE WHEN c_custkey IS NULL THEN 'no customer' WHEN o_orderkey IS NULL THEN 'no order' ELSE 'both' END AS state FROM"


@query(f"{_STATE} {_CUST} LEFT JOIN {_ORD} ON c_custkey = o_custkey")
def join_left(t):
    return _outer(t, "left_join")


@query(f"{_STATE} {_CUST} RIGHT JOIN {_ORD} ON c_custkey = o_custkey")
def join_right(t):
    return _outer(t, "right_join")


@query(f"{_STATE} {_CUST} FULL JOIN {_ORD} ON c_custkey = o_custkey")
def join_full_nil(t):
    return _outer(t, "full_join")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(t):
    a, b = t("region"), t("nation")
    return a.join(b, lambda j: j.all(), lambda s: s.left_fields(*fields(a, "r_name")).right_fields(*fields(b, "n_name")))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t):
    """The same fields on both sides."""
    s = t("nation")
    key, region = fields(s, "n_nationkey", "n_regionkey")
    return s.join(s, lambda j: j.all(j.eq(j.left(region), j.right(region)), j.lt(j.left(key), j.right(key))), lambda o: o.field(Field("a"), lambda x, _: x[key]).field(Field("b"), lambda _, y: y[key]))


def _nullable_sides(t):
    n, s = t("nation"), t("supplier")
    nk, (sk, sn) = fields(n, "n_nationkey")[0], fields(s, "s_suppkey", "s_nationkey")
    a, b, x, y = Field("a"), Field("b"), Field("x"), Field("y")
    left = n.select(lambda o: o.field(a, lambda r: r[nk]).field(x, lambda r: F.nullif(r[nk], F.lit(3))))
    right = s.select(lambda o: o.field(b, lambda r: r[sk]).field(y, lambda r: F.nullif(r[sn], F.lit(5))))
    return left, right, a, b, x, y


_SIDES = "FROM (SELECT n_nationkey AS a, nullif(n_nationkey, 3) AS x FROM nation) l JOIN (SELECT s_suppkey AS b, nullif(s_nationkey, 5) AS y FROM supplier) r ON"
_PRED_SQL = {
    "eq": "x IS NOT DISTINCT FROM y",
    "neq": "x IS DISTINCT FROM y",
    "ceq": "x IS NOT DISTINCT FROM y",
    "cneq": "x IS DISTINCT FROM y",
    "gt": "coalesce(x, -1) > coalesce(y, -1)",
    "gte": "coalesce(x, -1) >= coalesce(y, -1)",
    "lt": "coalesce(x, -1) < coalesce(y, -1)",
    "lte": "coalesce(x, -1) <= coalesce(y, -1)",
}


def _join_null(op: str):
    def fn(t):
        left, right, a, b, x, y = _nullable_sides(t)
        return left.join(right, lambda j: getattr(j, op)(j.left(x), j.right(y)), lambda s: s.left_field(a).right_field(b))

    fn.__name__, fn.__doc__ = f"join_{op}_null", f"{op} with null as the lowest value"
    query(f"SELECT a, b {_SIDES} {_PRED_SQL[op]}")(fn)


for _op in _PRED_SQL:
    _join_null(_op)


@query(f"SELECT a, b {_SIDES} coalesce(y, -1) > coalesce(x, -1) AND 7 >= coalesce(x, -1)")
def join_reversed_operands(t):
    """The right operand first, and a constant first."""
    left, right, a, b, x, y = _nullable_sides(t)
    return left.join(right, lambda j: j.all(j.gt(j.right(y), j.left(x)), j.gte(j.eval(lambda: 7), j.left(x))), lambda s: s.left_field(a).right_field(b))


@query(f"SELECT a, b {_SIDES} coalesce(x, -99) >= coalesce(y - 1, -99) AND coalesce(x, -99) <= coalesce(y + 2, -99)")
def join_between(t):
    left, right, a, b, x, y = _nullable_sides(t)
    return left.join(right, lambda j: j.between(j.left(x), j.right(lambda r: r[y] - 1), j.right(lambda r: r[y] + 2)), lambda s: s.left_field(a).right_field(b))


@query("SELECT p_partkey, s_suppkey FROM (SELECT p_partkey, p_retailprice FROM part) JOIN (SELECT s_suppkey, s_acctbal FROM supplier) ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 50")
def range_join_bucketed(t):
    """Points in intervals as an equi-join of ranges."""
    p, s = t("part", "p_partkey", "p_retailprice"), t("supplier", "s_suppkey", "s_acctbal")
    pk, price = fields(p, "p_partkey", "p_retailprice")
    sk, bal = fields(s, "s_suppkey", "s_acctbal")
    high = Field("high")
    s = s.select(lambda o: o.all_fields().field(high, lambda r: r[bal] + 50))
    return recipes.range_join(p, s, price, bal, high, lambda o: o.left_field(pk).right_field(sk))


@query(f"SELECT a, b {_SIDES} (x IS NOT DISTINCT FROM y AND a > 10) OR (a = 4 AND b < 9) OR (b = 5 AND coalesce(x, -1) < coalesce(y, -1))")
def join_any_all(t):
    left, right, a, b, x, y = _nullable_sides(t)
    on = lambda j: j.any(j.all(j.eq(j.left(x), j.right(y)), j.gt(j.left(a), j.val(10))), j.all(j.eq(j.left(a), j.val(4)), j.lt(j.right(b), j.val(9))), j.all(j.eq(j.right(b), j.val(5)), j.lt(j.left(x), j.right(y))))
    return left.join(right, on, lambda s: s.left_field(a).right_field(b))


@query(f"SELECT a, b {_SIDES} NOT (coalesce(x = y, FALSE) OR coalesce(y, -1) >= 10)")
def join_not(t):
    left, right, a, b, x, y = _nullable_sides(t)
    return left.join(right, lambda j: j.not_(j.any(j.match(lambda l, r: l[x] == r[y]), j.gte(j.right(y), j.val(10)))), lambda s: s.left_field(a).right_field(b))


@query("SELECT a, b FROM (SELECT n_nationkey AS a, nullif(n_nationkey, 3) AS x FROM nation) l LEFT JOIN (SELECT s_suppkey AS b, nullif(s_nationkey, 5) AS y FROM supplier) r ON coalesce(x < 6, FALSE) AND coalesce(y > 20, FALSE)")
def join_side_match(t):
    left, right, a, b, x, y = _nullable_sides(t)
    return left.left_join(right, lambda j: j.all(j.left_match(lambda r: r[x] < 6), j.right_match(lambda r: r[y] > 20)), lambda s: s.left_field(a).right_field(b))


@query(f"SELECT a, b {_SIDES} coalesce((x * 7 + y) % 11 = 0, FALSE)")
def join_theta(t):
    left, right, a, b, x, y = _nullable_sides(t)
    return left.join(right, lambda j: j.match(lambda l, r: (l[x] * 7 + r[y]) % 11 == 0), lambda s: s.left_field(a).right_field(b))


@query(
    """SELECT c_custkey, c_nationkey, o_totalprice, o_totalprice > 100000 AS big, CAST(o_totalprice > 100000 AS INT) + 1 AS class, c_custkey + CAST(o_totalprice > 100000 AS INT) + 1 AS post
    FROM customer JOIN orders ON c_custkey = o_custkey"""
)
def join_select_shared(t):
    """A shared intermediate over both sides, and a post-field."""
    c, o = t("customer"), t("orders")
    ck, cn = fields(c, "c_custkey", "c_nationkey")
    oc, price = fields(o, "o_custkey", "o_totalprice")
    big, kind, post = Field("big"), Field("class", "int"), Field("post", "long")
    out = lambda s: s.left_all_fields_except(*[f for f in c.header if f not in (ck, cn)]).right_field(price).fields(lambda _, b: b[price] > 100000, lambda f: f.field(big, lambda v: v).field(kind, lambda v: v.cast("int") + 1)).post_field(post, lambda r: r[ck] + r[kind])
    return c.join(o, lambda j: j.eq(j.left(ck), j.right(oc)), out)


def _parts_suppliers(t):
    p, s = t("part", "p_partkey", "p_size", "p_retailprice"), t("supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    pk, size, price = fields(p, "p_partkey", "p_size", "p_retailprice")
    sk, nation, bal = fields(s, "s_suppkey", "s_nationkey", "s_acctbal")
    return p, s, pk, size, price, sk, nation, bal


_PART = "SELECT p_partkey, p_size, p_retailprice FROM part p WHERE"


@query(f"{_PART} EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = p_size AND s_acctbal > p_retailprice)")
def semi_any(t):
    p, s, _, size, price, _, nation, bal = _parts_suppliers(t)
    return p.left_any_match(s, lambda j: j.all(j.eq(j.left(size), j.right(nation)), j.lt(j.left(price), j.right(bal))))


@query(f"{_PART} NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = p_size AND s_acctbal > p_retailprice)")
def semi_none(t):
    p, s, _, size, price, _, nation, bal = _parts_suppliers(t)
    return p.left_none_match(s, lambda j: j.all(j.eq(j.left(size), j.right(nation)), j.lt(j.left(price), j.right(bal))))


@query(f"{_PART} p_retailprice > (SELECT max(s_acctbal / 10) FROM supplier)")
def semi_all(t):
    """One comparison: decided by the right side's extreme."""
    p, s, _, _, price, sk, _, bal = _parts_suppliers(t)
    return p.left_all_match(s, lambda j: j.gt(j.left(price), j.right(lambda r: r[bal] / 10)))


@query(f"{_PART} EXISTS (SELECT 1 FROM supplier WHERE NOT (s_nationkey <> p_size OR s_acctbal > p_retailprice))")
def semi_not_all(t):
    p, s, _, size, price, sk, nation, bal = _parts_suppliers(t)
    return p.left_not_all_match(s, lambda j: j.any(j.neq(j.left(size), j.right(nation)), j.lt(j.left(price), j.right(bal))))


@query(f"{_PART} TRUE")
def semi_all_empty_right(t):
    p, s, _, _, price, sk, _, bal = _parts_suppliers(t)
    return p.left_all_match(s.filter(lambda r: r[sk] < 0), lambda j: j.gt(j.left(price), j.right(bal)))


# --- analytic functions ---------------------------------------------------------------------------------------------


def _win(name: str, fn, sql: str, kind: str | None = None, ordered: bool = True, doc: str = ""):
    def run(t):
        s = t("orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
        key, cust, price, prio = fields(s, "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
        by = [asc(prio)] if "rank" in name or "dist" in name else [asc(price), asc(key)]
        args = ([by] if ordered else []) + [fn(key, cust, price, prio)]
        return s.select(lambda o: o.fields(key, cust).window(lambda w: w.key(cust).field(Field("v", kind), *args)))

    run.__name__, run.__doc__ = name, doc
    query(f"SELECT o_orderkey, o_custkey, {sql} AS v FROM orders")(run)


_BY, _TIES = "(PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)", "(PARTITION BY o_custkey ORDER BY o_orderpriority)"
_win("win_row_number", lambda *_: an.row_number(0), f"row_number() OVER {_BY} - 1")
_win("win_rank", lambda *_: an.rank(1), f"rank() OVER {_TIES}")
_win("win_dense_rank", lambda *_: an.dense_rank(1), f"dense_rank() OVER {_TIES}")
_win("win_ntile", lambda *_: an.n_tile(1, 4), f"ntile(4) OVER {_BY}")
_win("win_lead", lambda key, *_: an.link(key, 2, -1), f"lead(o_orderkey, 2, -1) OVER {_BY}")
_win("win_lag", lambda key, *_: an.link(key, -1, 404), f"lag(o_orderkey, 1, 404) OVER {_BY}")
_win("win_cume_dist", lambda *_: lambda p: F.round(an.cume_dist()(p), 9), f"round(cume_dist() OVER {_TIES}, 9)")
_win("win_percent_rank", lambda *_: lambda p: F.round(an.percent_rank()(p), 9), f"round(percent_rank() OVER {_TIES}, 9)")
_win("win_percentile_cont", lambda key, cust, price, prio: lambda p: F.round(an.percentile_cont(0.7, price)(p), 4), "round(quantile_cont(o_totalprice, 0.7) OVER (PARTITION BY o_custkey), 4)")
_win("win_from_agg", lambda key, *_: an.from_agg(co.summing(key)), "CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey) AS BIGINT)", "long", False)


@query(
    """SELECT o_orderkey, o_custkey, v FROM orders JOIN
    (SELECT o_custkey, list_sort(list(o_totalprice))[CAST(ceil(0.25 * (count(*) - 1) - 0.5) AS INT) + 1] AS v FROM orders GROUP BY o_custkey) USING (o_custkey)"""
)
def win_percentile_disc(t):
    """The nearest record, not SQL's percentile_disc."""
    s = t("orders", "o_orderkey", "o_custkey", "o_totalprice")
    key, cust, price = fields(s, "o_orderkey", "o_custkey", "o_totalprice")
    return s.select(lambda o: o.fields(key, cust).window(lambda w: w.key(cust).field(Field("v"), [price], an.percentile_disc(0.25, price))))


@query(
    """SELECT event_id, count(*) OVER (PARTITION BY user_id) AS of_user, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY value DESC, event_id) AS place,
    sum(event_id) OVER (PARTITION BY event_type, CAST(ts AS DATE))::BIGINT AS total FROM events"""
)
def win_two_windows(t):
    """Two windows, keys of an intermediate, a custom function."""
    s = t("events")
    key, user, kind, ts, value = fields(s, "event_id", "user_id", "event_type", "ts", "value")
    of_user, place, total = Field("of_user"), Field("place"), Field("total", "long")
    second = lambda w: w.key(kind).keys(lambda r: r[ts].cast("date"), lambda k: k.key(lambda v: v)).field(place, [desc(value), asc(key)], an.row_number()).field(total, lambda p: F.sum(p.record[key]).over(p.whole()))
    return s.select(lambda o: o.field(key).window(lambda w: w.key(user).field(of_user, an.from_agg(co.counting()))).window(second))


# --- nested data, recursion, division, plain streams -------------------------------------------------------------------


@query("SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS element FROM embeddings")
def lateral_explode(t):
    s = t("embeddings")
    key, vector = fields(s, "vec_id", "embedding")
    element = Field("element", "double")
    return recipes.lateral(s.select(lambda o: o.fields(key, vector)), lambda r: r[vector].cast("array<double>"), [element]).select(lambda o: o.fields(key, element))


@query(
    """WITH RECURSIVE chain AS (SELECT n_nationkey, 0 AS depth, n_name AS path FROM nation WHERE n_nationkey = 0
    UNION ALL SELECT n.n_nationkey, c.depth + 1, c.path || '/' || n.n_name FROM chain c JOIN nation n ON n.n_nationkey > 0 AND (n.n_nationkey - 1) // 2 = c.n_nationkey) SELECT * FROM chain"""
)
def recursive_chain(t):
    """A tree in which k hangs below (k - 1) / 2."""
    s = t("nation")
    key, name = fields(s, "n_nationkey", "n_name")
    depth, path, above = Field("depth", "int"), Field("path"), Field("above")
    root = s.filter(lambda r: r[key] == 0).select(lambda o: o.field(key).field(depth, lambda _: F.lit(0)).field(path, lambda r: r[name]))
    below = s.filter(lambda r: r[key] > 0).select(lambda o: o.all_fields().field(above, lambda r: sc.div(r[key] - 1, 2)))
    out = lambda o: o.right_field(key).field(depth, lambda a, _: a[depth] + 1).field(path, lambda a, b: sc.text(a[path], "/", b[name]))
    return recipes.recursive(root, lambda level: level.join(below, lambda j: j.eq(j.left(key), j.right(above)), out))


@query("SELECT user_id FROM events WHERE event_type IN ('click', 'purchase', 'signup') GROUP BY user_id HAVING count(DISTINCT event_type) = 3")
def divide(t):
    """Users with all of some kinds of events."""
    s = t("events")
    user, kind = fields(s, "user_id", "event_type")
    needed = s.select(lambda o: o.field(kind)).filter(lambda r: r[kind].isin("click", "purchase", "signup")).distinct()
    return recipes.divide(s, user, kind, needed)


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def nested_sets(t):
    """Records nested in records, and read again."""
    r, n = t("region"), t("nation")
    rk, rn = fields(r, "r_regionkey", "r_name")
    nk, nn = fields(n, "n_regionkey", "n_name")
    nested = Field("nested")
    inner = n.aggregate(lambda a: a.key_field(nk).agg_field(nested, co.record_set(lambda i: i.field(nn))))
    shown = lambda _, b: F.array_join(F.array_sort(F.transform(b[nested], lambda x: x["n_name"])), ",")
    return r.join(inner, lambda j: j.eq(j.left(rk), j.right(nk)), lambda s: s.left_field(rn).field(Field("names"), shown).field(Field("n", "long"), lambda _, b: F.size(b[nested])))


@query("SELECT count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS sum, round(avg(l_linenumber), 9) AS average, min(l_linenumber) AS min, max(l_linenumber) AS max FROM lineitem")
def int_stream_stats(t):
    s = t("lineitem")
    (no,) = fields(s, "l_linenumber")
    return s.map_to_int(lambda r: r[no]).statistics_df().withColumn("average", F.round("average", 9))


@query("SELECT DISTINCT CAST(floor(l_quantity) AS BIGINT) * 2 AS doubled FROM lineitem WHERE l_quantity > 10")
def aux_map_filter_distinct(t):
    """A plain stream and back to records."""
    s = t("lineitem")
    (qty,) = fields(s, "l_quantity")
    values = s.filter(lambda r: r[qty] > 10).map_to_long(lambda r: F.floor(r[qty]))
    return values.map(lambda v: v * 2).distinct().map_to_record(lambda i: i.field(Field("doubled"), lambda v: v))


@query("SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def stream_static_join(t):
    """Orders as a file stream, customers as a static table; run to the end of what is there."""
    c = t("customer")
    spark = c.df.sparkSession
    path = c.df.inputFiles()[0].rsplit("customer.parquet", 1)[0]
    o = streaming.parquet_stream(spark, f"{path}[o]rders.parquet", f"{path}orders.parquet")
    ok, oc, price, status = fields(o, "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    ck, seg = fields(c, "c_custkey", "c_mktsegment")
    joined = o.filter(lambda r: r[status] == "O").join(c, lambda j: j.eq(j.left(oc), j.right(ck)), lambda s: s.left_fields(ok, price).right_field(seg))
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    streaming.write_parquet(joined, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


from . import more  # noqa: E402, F401  (registers its queries)
