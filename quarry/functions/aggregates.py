"""Aggregates: builders from (expression, its type) to an aggregate Column, all with partial aggregation in Spark."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidOperation, TypeMismatch

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBERS = (*_INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)


def _integer(x: Column, kind: T.DataType, name: str) -> Column:
    if not isinstance(kind, _INTEGERS):
        raise TypeMismatch(f"{name} of {kind.simpleString()}")
    return x.cast("long")


def _number(x: Column, kind: T.DataType, name: str) -> Column:
    if not isinstance(kind, _NUMBERS):
        raise TypeMismatch(f"{name} of {kind.simpleString()}")
    return x


def count(x, kind, order=None):
    """Rows, nulls among them."""
    return F.count(F.lit(1))


def sum_(x, kind, order=None):
    return F.sum(_integer(x, kind, "sum"))


def avg(x, kind, order=None):
    """Exact sum over count: overflows where the sum does."""
    v = _integer(x, kind, "avg")
    return F.sum(v).cast("double") / F.nullif(F.count(v), F.lit(0))


def min_(x, kind, order=None):
    return F.min(x)


def max_(x, kind, order=None):
    return F.max(x)


def group_concat(separator: str = ",") -> Callable:
    """Text of all values in order, nulls left out; of none, the empty text."""

    def build(x, kind, order=None):
        if not isinstance(kind, T.StringType):
            raise TypeMismatch(f"group_concat of {kind.simpleString()}")
        if order is None:
            return F.coalesce(F.listagg(x, F.lit(separator)), F.lit(""))
        ordered = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x")))))
        return F.array_join(F.transform(ordered, lambda s: s["x"]), separator)

    return build


def total(x, kind, order=None):
    """Sum as a double; other types count nothing; of none, 0.0."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0)) if isinstance(kind, _NUMBERS) else F.coalesce(F.max(F.lit(0.0)), F.lit(0.0))


def _share(p: float) -> float:
    if not 0.0 <= p <= 1.0:
        raise InvalidOperation("a percentile is between 0 and 1")
    return float(p)


def percentile_cont(p: float = 0.5) -> Callable:
    return lambda x, kind, order=None: F.percentile(_number(x, kind, "percentile_cont").cast("double"), F.lit(_share(p)))


def percentile_disc(p: float = 0.5) -> Callable:
    """The value at place ceil(n p), of all values in order. ``x``: a column by name, as queries give it."""

    def build(x, kind, order=None):
        _number(x, kind, "percentile_disc")
        name = re.fullmatch(r"Column<'(.*)'>", str(x))[1]
        if not re.fullmatch(r"[\w.`]+", name):
            raise InvalidOperation("percentile_disc takes a column by name: project the expression first")
        return F.expr(f"cast(percentile_disc({_share(p)}D) within group (order by cast({name} as double)) as double)")

    return build


def median(x, kind, order=None):
    return percentile_cont(0.5)(x, kind)


def combined(prepare: Callable[[Column], Column], aggregate: Callable[[Column], Column], finish: Callable[[Column], Column] | None = None) -> Callable:
    """A user's aggregate of prepared values by a built-in one: ``finish(aggregate(prepare(x)))``, partial before the shuffle."""

    def build(x, kind, order=None):
        out = aggregate(prepare(x))
        return finish(out) if finish else out

    return build


def folded(init: Column, merge: Callable, finish: Callable | None = None) -> Callable:
    """A user's aggregate: a fold of a group's non-null values by Column lambdas. It gathers a group's values, so groups must be of bounded size.

    What a built-in aggregate of prepared values can do, ``combined`` does without gathering.
    """

    def build(x, kind, order=None):
        args = (F.collect_list(x), init, merge)
        return F.aggregate(*args, finish) if finish else F.aggregate(*args)

    return build


AGGREGATES = {
    "count": count, "sum": sum_, "avg": avg, "min": min_, "max": max_, "group_concat": group_concat(), "string_agg": group_concat(),
    "total": total, "median": median, "percentile_cont": percentile_cont(), "percentile_disc": percentile_disc(),
}
