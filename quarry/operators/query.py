"""The fluent query: buffered operators that become one DataFrame plan.

Whatever the order of the calls, filters come first, then the sort, the offset and the limit; the last
limit and the last offset count. Several sorts are one, the first call's keys leading. Rows that sort
equal keep the order of ``_row_idx`` where the table has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidOperation, from_spark
from ..functions.registry import registry, type_in

ROW_INDEX = "_row_idx"


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _kind(kind: T.DataType) -> str:
    """The kind of a join key: all integers are one, and both floating point types."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    return "double" if isinstance(kind, (T.FloatType, T.DoubleType)) else kind.simpleString()


class Query:
    """Lazy query over a DataFrame, or a table of a store."""

    def __init__(self, source, table: str | None = None):
        self.df: DataFrame = source.scan(table) if table is not None else source
        self._filters: list[Column] = []
        self._sorts: list[Column] = []
        self._limit: int | None = None
        self._offset: int | None = None

    def filter(self, condition: Column | str | Callable) -> Query:
        """A Column, SQL text, or (the slow path) a function of a row's values as a dict."""
        if isinstance(condition, Column):
            self._filters.append(condition)
        elif isinstance(condition, str):
            self._filters.append(F.expr(condition))
        else:
            names = self.df.columns
            test = F.udf(lambda row: bool(condition(dict(zip(names, row)))), "boolean")
            self._filters.append(test(F.struct(*(F.col(f"`{n}`") for n in names))))
        return self

    def sort_by(self, *keys: Column | str) -> Query:
        self._sorts += [_column(k) for k in keys]
        return self

    def limit(self, n: int) -> Query:
        if n < 0:
            raise InvalidOperation("negative limit")
        self._limit = n
        return self

    def offset(self, n: int) -> Query:
        if n < 0:
            raise InvalidOperation("negative offset")
        self._offset = n
        return self

    def execute(self) -> DataFrame:
        """The plan as a DataFrame."""
        try:
            df = self.df
            for f in self._filters:
                df = df.filter(f)
            cut = self._limit is not None or self._offset
            ties = [F.col(ROW_INDEX)] if ROW_INDEX in df.columns and (self._sorts or cut) else []
            if self._sorts or ties:
                df = df.orderBy(*self._sorts, *ties)
            if self._offset:
                df = df.offset(self._offset)
            return df if self._limit is None else df.limit(self._limit)
        except AnalysisException as e:
            raise from_spark(e) from e

    def rows(self) -> list:
        """All rows on the driver, for small results."""
        return self.execute().collect()

    def project(self, *expressions: Column | str) -> Query:
        """The expressions of this query's rows, as a query that takes further operators."""
        return Query(self.execute().select(*(e if isinstance(e, Column) else F.expr(e) for e in expressions)))

    def aggregate(self, f: Callable, expression: Column | str, name: str = "value") -> DataFrame:
        """One row: an aggregate (a builder of a Column) of an expression over this query's rows."""
        df = self.execute().withColumn("_q_x", _column(expression))
        x = F.col("_q_x")
        return df.agg(f(x, type_in(df, x), F.col(ROW_INDEX) if ROW_INDEX in df.columns else None).alias(name))

    def aggregate_by_name(self, function: str, expression: Column | str, name: str = "value") -> DataFrame:
        return self.aggregate(registry().get_aggregate(function), expression, name)

    def group_by(self, *keys: Column | str, **aggregates: tuple) -> DataFrame:
        """Groups by the keys (null is one). ``name=(function, expression)`` aggregates; none: the groups' rows as lists.

        Lists hold a whole group in a row: for groups of bounded size.
        """
        df = self.execute()
        columns = [_column(k) for k in keys]
        if not aggregates:
            return df.groupBy(*columns).agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
        order = F.col(ROW_INDEX) if ROW_INDEX in df.columns else None
        df = df.withColumns({f"_q_x{k}": _column(a[1]) for k, a in enumerate(aggregates.values())})
        out = []
        for k, (name, (function, _, *rest)) in enumerate(aggregates.items()):
            build = registry().get_aggregate(function) if isinstance(function, str) else function
            x = F.col(f"_q_x{k}")
            out.append(build(x, type_in(df, x), _column(rest[0]) if rest else order).alias(name))
        return df.groupBy(*columns).agg(*out)

    def _join(self, right: DataFrame, left_key, right_key, how: str) -> DataFrame:
        left = self.execute()
        if ROW_INDEX in left.columns:
            left = left.drop(ROW_INDEX)
        if ROW_INDEX in right.columns:
            right = right.drop(ROW_INDEX)
        taken = {c.lower() for c in left.columns}
        renamed = []
        for c in right.columns:
            name = c
            while name.lower() in taken:
                name += "_right"
            taken.add(name.lower())
            renamed.append(name)
        a, b = (k if isinstance(k, Column) else F.col(k) for k in (left_key, right_key))
        kinds = [_kind(type_in(left, a)), _kind(type_in(right, b))]
        same = kinds[0] == kinds[1]
        if same and kinds[0] in ("bigint", "double"):
            a, b = a.cast(kinds[0]), b.cast(kinds[0])
        left, right = left.withColumn("_q_left", a), right.select(b.alias("_q_right"), *(F.col(f"`{c}`").alias(n) for c, n in zip(right.columns, renamed)))
        # Values of different types are never equal; nulls are equal to nulls.
        on = F.col("_q_left").eqNullSafe(F.col("_q_right")) if same else F.lit(False)
        return left.join(right, on, how).drop("_q_left", "_q_right")

    def join_inner(self, right, left_key, right_key) -> DataFrame:
        """This query's rows with the rows of all of ``right`` of the same key: left columns, then right ones (clashing names get ``_right``)."""
        return self._join(getattr(right, "df", right), left_key, right_key, "inner")

    def join_left(self, right, right_columns: int | None, left_key, right_key) -> DataFrame:
        """As join_inner, and each row without a partner once, with nulls. ``right_columns``, if given, must be the right side's width."""
        right = getattr(right, "df", right)
        width = len([c for c in right.columns if c != ROW_INDEX])
        if right_columns is not None and right_columns != width:
            raise InvalidOperation(f"{right_columns} columns of {width}")
        return self._join(right, left_key, right_key, "left")

    def window(self, function: str | Callable, *args, partition_by=(), order_by=(), name: str = "value") -> DataFrame:
        """This query's rows with a window function; arguments that are text name columns."""
        build = registry().get_window(function) if isinstance(function, str) else function
        values = [_column(a) if k == 0 and isinstance(a, str) else a for k, a in enumerate(args)]
        return self.execute().withColumn(name, build(values, [_column(p) for p in partition_by], [_column(o) for o in order_by]))

    def scalar(self, function: str, *args, name: str = "value", **options) -> DataFrame:
        """This query's rows with a registered scalar of columns."""
        df = self.execute()
        return df.withColumn(name, registry().scalar(df, function, *(_column(a) for a in args), **options))


def query(source, table: str | None = None, **operators) -> DataFrame:
    """``query(df, filter=..., sort_by=..., limit=..., offset=...)``; a list of filters or keys is several."""
    return _applied(Query(source, table), operators).execute()


def query_project(source, table: str | None = None, project=(), **operators) -> DataFrame:
    """As ``query``, with the rows projected at the end."""
    return _applied(Query(source, table), operators).project(*(project if isinstance(project, (list, tuple)) else [project])).execute()


def _applied(q: Query, operators: dict) -> Query:
    for name, value in operators.items():
        if name not in ("filter", "sort_by", "limit", "offset"):
            raise InvalidOperation(f"unknown operator {name}")
        for v in value if isinstance(value, (list, tuple)) else [value]:
            getattr(q, name)(v)
    return q
