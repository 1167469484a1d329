"""Join predicates: two-valued conditions over both sides, null being an ordinary value and the lowest one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..field import Field, FieldPin
from ..record import Record, as_column

LEFT, RIGHT = 1, 2


@dataclass(frozen=True, eq=False)
class Expr:
    """An operand: a column, and the sides it reads."""

    column: Column
    sides: int


@dataclass(frozen=True, eq=False)
class Interval:
    """A value of one side between two of the other, both ends included."""

    point_side: int
    point: Column
    low: Column
    high: Column


@dataclass(frozen=True, eq=False)
class Pred:
    """A condition that is never null, and how a join may look for its pairs.

    ``range``: (operator, left operand, right operand) if it is a plain comparison of the two sides. ``search``: a comparison or an
    interval that all pairs satisfy. ``equi``: all pairs agree in some expression of each side. ``parts``: conditions of which one
    holds for every pair. ``one_sided``: each side is judged by itself. ``plain``: ``search`` is an interval and all that is asked.
    """

    column: Column
    range: tuple[str, Column, Column] | None = None
    search: tuple[str, Column, Column] | Interval | None = None
    equi: bool = False
    parts: tuple[Pred, ...] = ()
    one_sided: bool = False
    plain: bool = False

    def indexed(self) -> bool:
        """Pairs are found without comparing all with all, or all with all are asked for."""
        return self.equi or self.one_sided or self.search is not None or bool(self.parts)


def null_safe(op: str, a: Column, b: Column) -> Column:
    if op in ("eq", "neq"):
        return a.eqNullSafe(b) if op == "eq" else ~a.eqNullSafe(b)
    if op == "gt":
        return F.coalesce(a > b, a.isNotNull() & b.isNull())
    if op == "gte":
        return F.coalesce(a >= b, b.isNull())
    if op == "lt":
        return F.coalesce(a < b, a.isNull() & b.isNotNull())
    return F.coalesce(a <= b, a.isNull())


FLIPPED = {"gt": "lt", "gte": "lte", "lt": "gt", "lte": "gte"}
NEGATED = {"gt": "lte", "gte": "lt", "lt": "gte", "lte": "gt"}


class On:
    """What the ``on`` lambda of a join works with."""

    def __init__(self, left: Record, right: Record):
        self._left, self._right = left, right

    def _side(self, record: Record, what, side: int) -> Expr:
        return Expr(record[what] if isinstance(what, (Field, FieldPin)) else as_column(what(record)), side)

    def left(self, what) -> Expr:
        return self._side(self._left, what, LEFT)

    def right(self, what) -> Expr:
        return self._side(self._right, what, RIGHT)

    def val(self, value) -> Expr:
        return Expr(as_column(value), 0)

    def eval(self, supplier: Callable[[], object]) -> Expr:
        """A constant that is made once, when the plan is built."""
        return self.val(supplier())

    def _compare(self, op: str, a: Expr, b: Expr) -> Pred:
        plain = None
        if op in FLIPPED and {a.sides, b.sides} == {LEFT, RIGHT}:
            plain = (op, a.column, b.column) if a.sides == LEFT else (FLIPPED[op], b.column, a.column)
        across = {a.sides, b.sides} == {LEFT, RIGHT}
        return Pred(null_safe(op, a.column, b.column), plain, plain, equi=op == "eq" and across, one_sided=not across)

    def eq(self, a: Expr, b: Expr) -> Pred:
        return self._compare("eq", a, b)

    def neq(self, a: Expr, b: Expr) -> Pred:
        return self._compare("neq", a, b)

    ceq, cneq = eq, neq  # equality and equality by comparison are one for Spark's types

    def gt(self, a: Expr, b: Expr) -> Pred:
        return self._compare("gt", a, b)

    def gte(self, a: Expr, b: Expr) -> Pred:
        return self._compare("gte", a, b)

    def lt(self, a: Expr, b: Expr) -> Pred:
        return self._compare("lt", a, b)

    def lte(self, a: Expr, b: Expr) -> Pred:
        return self._compare("lte", a, b)

    def between(self, tested: Expr, low: Expr, high: Expr) -> Pred:
        both = self.all(self.gte(tested, low), self.lte(tested, high))
        if low.sides == high.sides and {tested.sides, low.sides} == {LEFT, RIGHT}:
            return replace(both, search=Interval(tested.sides, tested.column, low.column, high.column), plain=True)
        return both

    def not_(self, pred: Pred) -> Pred:
        if pred.range:
            op, a, b = pred.range
            plain = (NEGATED[op], a, b)
            return Pred(~pred.column, plain, plain)
        return Pred(~pred.column, one_sided=pred.one_sided)

    def any(self, *preds: Pred) -> Pred:
        if len(preds) == 1:
            return preds[0]
        whole = reduce(lambda a, b: a | b, [p.column for p in preds], F.lit(False))
        one_sided = all(p.one_sided for p in preds)
        return Pred(whole, one_sided=one_sided, parts=preds if not one_sided and all(p.indexed() for p in preds) else ())

    def all(self, *preds: Pred) -> Pred:
        if len(preds) == 1:
            return preds[0]
        whole = reduce(lambda a, b: a & b, [p.column for p in preds]) if preds else F.lit(True)
        equi, found = any(p.equi for p in preds), [p.search for p in preds if p.search is not None]
        search = next((x for x in found if isinstance(x, Interval)), found[0] if found else None)
        parts: tuple[Pred, ...] = ()
        if not equi and search is None:  # an alternative inside, each with the other conditions
            at = next((i for i, p in enumerate(preds) if p.parts), None)
            if at is not None:
                parts = tuple(self.all(x, *preds[:at], *preds[at + 1 :]) for x in preds[at].parts)
        return Pred(whole, None, None if equi else search, equi, parts, all(p.one_sided for p in preds))

    def left_match(self, test: Callable[[Record], Column]) -> Pred:
        return Pred(F.coalesce(as_column(test(self._left)), F.lit(False)), one_sided=True)

    def right_match(self, test: Callable[[Record], Column]) -> Pred:
        return Pred(F.coalesce(as_column(test(self._right)), F.lit(False)), one_sided=True)

    def match(self, test: Callable[[Record, Record], Column]) -> Pred:
        return Pred(F.coalesce(as_column(test(self._left, self._right)), F.lit(False)))
