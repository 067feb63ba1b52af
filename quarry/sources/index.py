"""A multi-map index: each key with the different numbers of its rows.

The bulk of an index is a table (key, row), which Spark filters and groups; changes made one by one are a
small overlay on the driver, folded into the table once there are ``MAX_CHANGES``. Ordered or hashed access
is Spark's choice, so one class serves both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidOperation, TypeMismatch
from ..schema import TYPES, type_of
from .contracts import Index

MAX_CHANGES = 10_000


def index_key(key: Column, kind: T.DataType) -> Column:
    """The value by which a key is held: minus zero is zero."""
    return F.when(key == 0, F.lit(0.0).cast(kind)).otherwise(key) if isinstance(kind, (T.DoubleType, T.FloatType)) else key


class RowIndex(Index):
    """Keys of one type with their rows' numbers."""

    def __init__(self, spark: SparkSession, kind: str):
        if kind not in TYPES or kind == "NULL":
            raise TypeMismatch(f"no index of {kind}")
        self.spark, self.kind = spark, kind
        self.struct = T.StructType([T.StructField("key", TYPES[kind]), T.StructField("row", T.LongType())])
        self.clear()

    @classmethod
    def of(cls, df: DataFrame, key: str, row: str, kind: str) -> RowIndex:
        """An index of a table's column."""
        out = cls(df.sparkSession, kind)
        out.insert_all(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{row}`").alias("row")))
        return out

    def clear(self) -> None:
        self.table: DataFrame | None = None
        #: (key, row): whether it is there, over what the table says.
        self.changes: dict[tuple, bool] = {}

    def _key(self, key):
        """The key as it is held; None where it is not."""
        if key is None or type_of(key) != self.kind:
            return None
        if isinstance(key, float):
            return key + 0.0
        return bytes(key) if isinstance(key, bytearray) else key

    def insert_all(self, rows: DataFrame) -> None:
        """Adds a table (key, row); what it holds twice counts once."""
        if rows.schema["key"].dataType != TYPES[self.kind]:
            raise TypeMismatch(f"{rows.schema['key'].dataType.simpleString()} for {self.kind}")
        kept = rows.where("key is not null").select(index_key(F.col("key"), TYPES[self.kind]).alias("key"), F.col("row").cast("long").alias("row"))
        self.table = (kept if self.table is None else self.entries().union(kept)).distinct()
        self.changes = {}

    def _change(self, key, row: int, there: bool) -> None:
        if row < 0:
            raise InvalidOperation("negative row")
        held = self._key(key)
        if held is None:
            return
        self.changes[held, row] = there
        if len(self.changes) >= MAX_CHANGES:
            self.table, self.changes = self.entries(), {}

    def insert(self, key, row: int) -> None:
        self._change(key, row, True)

    def remove(self, key, row: int) -> None:
        self._change(key, row, False)

    def _overlay(self, there: bool | None = None) -> DataFrame:
        return self.spark.createDataFrame([k for k, v in self.changes.items() if there is None or v == there], self.struct)

    def entries(self) -> DataFrame:
        """(key, row) of all that is held."""
        table = self.table if self.table is not None else self.spark.createDataFrame([], self.struct)
        if not self.changes:
            return table
        return table.join(F.broadcast(self._overlay()), ["key", "row"], "left_anti").union(self._overlay(True))

    def groups(self) -> DataFrame:
        """Each key with its rows' numbers in order."""
        return self.entries().groupBy("key").agg(F.array_sort(F.collect_set("row")).alias("rows"))

    def rows_of(self, key) -> DataFrame:
        """The numbers of a key's rows."""
        held = self._key(key)
        return self.entries().where(F.lit(False) if held is None else F.col("key") == F.lit(held)).select("row")

    def lookup(self, key) -> list[int] | None:
        """The numbers of a key's rows in order; none if it is not held."""
        found = sorted(r["row"] for r in self.rows_of(key).collect())
        return found or None

    def contains(self, key) -> bool:
        return self.rows_of(key).limit(1).count() > 0
