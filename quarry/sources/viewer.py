"""Looking into a store: its tables, their schemas, and rows by number."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import InvalidOperation
from .store import TableStore


class Viewer:
    """Reads a store without taking its lock."""

    def __init__(self, store: TableStore):
        self.store = store

    def tables(self) -> DataFrame:
        """Each table with its numbers of columns and rows."""
        rows = [(name, len(self.store.schema(name).columns), self.store.row_count(name)) for name in sorted(self.store.tables)]
        return self.store.spark.createDataFrame(rows, "name string, columns int, rows long")

    def describe(self, name: str) -> DataFrame:
        """A table's columns."""
        rows = [(k, c.name, c.kind, c.primary_key, c.nullable) for k, c in enumerate(self.store.schema(name).columns)]
        return self.store.spark.createDataFrame(rows, "place int, name string, kind string, primary_key boolean, nullable boolean")

    def rows(self, name: str, start: int = 0, limit: int = 20) -> DataFrame:
        """Rows ``start`` to ``start + limit - 1``, in order; only their segments are read."""
        if start < 0 or limit < 0:
            raise InvalidOperation("negative range")
        return self.store.rows_between(name, start, start + limit)
