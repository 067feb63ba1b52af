"""The registry of scalar, aggregate and window functions, three separate name spaces."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame

from ..errors import Unsupported
from . import aggregates, datetime, math, strings, windows


def type_in(df: DataFrame, x: Column):
    """Type of an expression over a table's columns."""
    return df.select(x.alias("x")).schema[0].dataType


class FunctionRegistry:
    """Names to builders of Columns; a name registered again replaces, and the one before is returned."""

    def __init__(self):
        self._scalars = {**math.SCALARS, **strings.SCALARS, **datetime.SCALARS}
        self._aggregates = dict(aggregates.AGGREGATES)
        self._windows = dict(windows.WINDOWS)

    @staticmethod
    def _put(names: dict, name: str, f: Callable) -> Callable | None:
        old = names.get(name)
        names[name] = f
        return old

    def register_scalar(self, name: str, f: Callable) -> Callable | None:
        """``f(columns, kinds, **options)``; prefer Column expressions, else a pandas_udf applied to the columns."""
        return self._put(self._scalars, name, f)

    def register_aggregate(self, name: str, f: Callable) -> Callable | None:
        return self._put(self._aggregates, name, f)

    def register_window(self, name: str, f: Callable) -> Callable | None:
        return self._put(self._windows, name, f)

    @staticmethod
    def _get(names: dict, name: str, what: str) -> Callable:
        if name not in names:
            raise Unsupported(f"no {what} function {name}")
        return names[name]

    def get_scalar(self, name: str) -> Callable:
        return self._get(self._scalars, name, "scalar")

    def get_aggregate(self, name: str) -> Callable:
        return self._get(self._aggregates, name, "aggregate")

    def get_window(self, name: str) -> Callable:
        return self._get(self._windows, name, "window")

    def names(self) -> dict[str, list[str]]:
        return {"scalar": sorted(self._scalars), "aggregate": sorted(self._aggregates), "window": sorted(self._windows)}

    def scalar(self, df: DataFrame, name: str, *columns: Column, **options) -> Column:
        """A scalar of columns of ``df``, typed by its schema."""
        return self.get_scalar(name)(list(columns), [type_in(df, c) for c in columns], **options)


@lru_cache(maxsize=1)
def registry() -> FunctionRegistry:
    """The shared registry, which queries use by name."""
    return FunctionRegistry()
