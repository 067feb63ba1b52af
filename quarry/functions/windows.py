"""Window functions: builders from (arguments, partition, order) to a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidOperation


def spec(partition: list[Column], order: list[Column]) -> WindowSpec:
    """A window of rows in order; without partition columns all rows are one partition, as asked."""
    out = W.partitionBy(*partition) if partition else W.partitionBy()
    return out.orderBy(*order) if order else out


def _whole(partition, order) -> WindowSpec:
    return spec(partition, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def _ranked(f: Callable, lone) -> Callable:
    """A function of the order's values; without an order every row is the first and only one."""
    return lambda args, partition, order: f().over(spec(partition, order)) if order else F.lit(lone)


def _literal(args, k: int, name: str, least: int) -> int:
    value = args[k]
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise InvalidOperation(f"{name} needs a whole number of {least} or more")
    return value


def row_number(args, partition, order):
    return F.row_number().over(spec(partition, order or [F.lit(1)])).cast("long")


def ntile(args, partition, order):
    n = _literal(args, 0, "ntile", 1)
    return F.ntile(n).over(spec(partition, order or [F.lit(1)])).cast("long")


def _offset(f: Callable, name: str) -> Callable:
    def build(args, partition, order):
        n = _literal(args, 1, name, 0) if len(args) > 1 else 1
        default = args[2] if len(args) > 2 else None
        return f(args[0], n, default).over(spec(partition, order or [F.lit(1)]))

    return build


def first_value(args, partition, order):
    return F.first_value(args[0]).over(_whole(partition, order))


def last_value(args, partition, order):
    return F.last_value(args[0]).over(_whole(partition, order))


def nth_value(args, partition, order):
    return F.nth_value(args[0], _literal(args, 1, "nth_value", 1)).over(_whole(partition, order or [F.lit(1)]))


def over_partition(build: Callable[[Column, Column], Column]) -> Callable:
    """A user's window function of the partition's values in order (an array) and the row's place in it (from 0).

    It gathers a partition's values on every row, so partitions must be of bounded size.
    """

    def make(args, partition, order):
        values = F.collect_list(args[0]).over(_whole(partition, order))
        return build(values, F.row_number().over(spec(partition, order or [F.lit(1)])) - 1)

    return make


WINDOWS = {
    "row_number": row_number,
    "rank": _ranked(lambda: F.rank(), 1),
    "dense_rank": _ranked(lambda: F.dense_rank(), 1),
    "percent_rank": _ranked(lambda: F.percent_rank(), 0.0),
    "cume_dist": _ranked(lambda: F.cume_dist(), 1.0),
    "ntile": ntile,
    "lag": _offset(F.lag, "lag"),
    "lead": _offset(F.lead, "lead"),
    "first_value": first_value,
    "last_value": last_value,
    "nth_value": nth_value,
}
