"""A table store on Parquet: declared schemas, versions, atomic commits.

A store is a folder that driver and executors share. Each commit is one manifest, written whole and moved into
place under the next number; a reader sees the last one and needs no lock. A table is a list of segments (folders of
Parquet files) of at most ``SEGMENT_ROWS`` rows, each with its range of row numbers and of primary keys. So a lookup, a key
check or a changed cell touches only the segments that may hold the row. Key filters and ranges are pushed into
the scan; segments are sorted by the primary key within files, so row groups are skipped by their statistics.

One writer at a time holds the lock, a lease: it is free again when its holder closes the store, is no more, or has not committed
for ``LEASE_SECONDS``. A writer that has lost its lease commits nothing.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
import weakref

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CorruptData, InvalidOperation, Locked, TableNotFound, Unsupported
from ..operators.query import ROW_INDEX
from ..schema import MAX_TABLES, TYPES, TableSchema, check_name, type_of
from .contracts import CatalogStore, RowStore
from .index import RowIndex

_DIGITS = 12
#: Rows of a segment, and seconds after which a silent writer's lock is free.
SEGMENT_ROWS, LEASE_SECONDS = 1_000_000, 600
#: Holders of this process that are still in use.
_LIVE: weakref.WeakValueDictionary[str, TableStore] = weakref.WeakValueDictionary()


class Files:
    """The few file operations of commits, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(path))] if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A new file; an error if it is there."""
        stream = self.fs.create(self.path(path), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def replace(self, path: str, text: str) -> None:
        """A file with new contents."""
        stream = self.fs.create(self.path(path), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def rename(self, old: str, new: str) -> bool:
        return not self.exists(new) and self.fs.rename(self.path(old), self.path(new))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


class TableStore(CatalogStore, RowStore):
    """Tables of a folder; one writer at a time, any number of readers (``read_only``)."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self.files = Files(spark, self.root)
        self.holder = uuid.uuid4().hex
        if not read_only:
            self._lock()
        self.refresh()

    def refresh(self) -> None:
        """Sees what has been committed since."""
        found = sorted(n for n in self.files.names(f"{self.root}/manifests") if n.isdigit())
        self.version = int(found[-1]) if found else 0
        try:
            self.tables: dict[str, dict] = json.loads(self.files.read(f"{self.root}/manifests/{found[-1]}")) if found else {}
        except ValueError as e:
            raise CorruptData(f"manifest {found[-1]}") from e

    def __enter__(self) -> TableStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # The writer's lock

    def _lock_text(self) -> str:
        return json.dumps({"holder": self.holder, "host": socket.gethostname(), "pid": os.getpid(), "time": time.time()})

    def _held(self) -> dict:
        """What the lock says; nothing where there is none or it is not whole."""
        try:
            return json.loads(self.files.read(f"{self.root}/LOCK"))
        except Exception:
            return {}

    @staticmethod
    def _is_gone(lock: dict) -> bool:
        """Whether a lock's holder is no more, or silent for too long."""
        if time.time() - lock.get("time", 0.0) > LEASE_SECONDS:
            return True
        if lock.get("host") != socket.gethostname():
            return False
        if lock.get("pid") == os.getpid():
            return lock.get("holder") not in _LIVE
        try:
            os.kill(int(lock["pid"]), 0)
        except ProcessLookupError:
            return True
        except OSError:
            pass
        return False

    def _lock(self) -> None:
        path = f"{self.root}/LOCK"
        if self.files.exists(path):
            lock = self._held()
            if not self._is_gone(lock):
                raise Locked(self.root)
            # Of several that find it free, the one that moves it away takes it.
            aside = f"{self.root}/.lock-{uuid.uuid4().hex}"
            if not self.files.rename(path, aside):
                raise Locked(self.root)
            self.files.delete(aside)
        try:
            self.files.write(path, self._lock_text())
        except Exception as e:
            raise Locked(self.root) from e
        _LIVE[self.holder] = self

    def _commit(self, tables: dict) -> None:
        if self.read_only:
            raise Unsupported("opened for reading")
        if self._held().get("holder") != self.holder:
            raise Locked(f"{self.root}: the lease is lost")
        name, temporary = f"{self.version + 1:0{_DIGITS}d}", f"{self.root}/manifests/.{uuid.uuid4().hex}"
        self.files.write(temporary, json.dumps(tables))
        if not self.files.rename(temporary, f"{self.root}/manifests/{name}"):
            raise Locked(f"version {name} is taken")
        self.version, self.tables = self.version + 1, tables
        self.files.replace(f"{self.root}/LOCK", self._lock_text())

    def _table(self, name: str) -> dict:
        if name not in self.tables:
            raise TableNotFound(name)
        return self.tables[name]

    # Tables

    def create_table(self, schema: TableSchema) -> None:
        if schema.name in self.tables:
            raise InvalidOperation(f"{schema.name} exists")
        if len(self.tables) >= MAX_TABLES:
            raise InvalidOperation("too many tables")
        self._commit({**self.tables, schema.name: {"schema": schema.to_json(), "segments": [], "next_row": 0}})

    def drop_table(self, name: str) -> None:
        self._table(name)
        self._commit({k: v for k, v in self.tables.items() if k != name})

    def rename_table(self, old: str, new: str) -> None:
        entry = self._table(old)
        if old == new:
            return
        check_name(new, "table name")
        if new in self.tables:
            raise InvalidOperation(f"{new} exists")
        schema = TableSchema(new, TableSchema.from_json(entry["schema"]).columns)
        self._commit({k: v for k, v in self.tables.items() if k != old} | {new: entry | {"schema": schema.to_json()}})

    def replace_table(self, name: str, schema: TableSchema) -> None:
        """An empty table of another schema under the same name."""
        self._table(name)
        if schema.name != name:
            raise InvalidOperation(f"{schema.name} is not {name}")
        self._commit(self.tables | {name: {"schema": schema.to_json(), "segments": [], "next_row": 0}})

    def catalog(self) -> dict[str, TableSchema]:
        return {k: TableSchema.from_json(v["schema"]) for k, v in self.tables.items()}

    def schema(self, name: str) -> TableSchema:
        return TableSchema.from_json(self._table(name)["schema"])

    # Reads

    def _read(self, schema: TableSchema, segments: list[dict]) -> DataFrame:
        struct = T.StructType([T.StructField(ROW_INDEX, T.LongType()), *(f for f in schema.to_struct() if not isinstance(f.dataType, T.NullType))])
        paths = [f"{self.root}/data/{s['path']}" for s in segments]
        df = self.spark.read.schema(struct).parquet(*paths) if paths else self.spark.createDataFrame([], struct)
        return df.select(ROW_INDEX, *(F.col(f"`{c.name}`") if c.kind != "NULL" else F.lit(None).alias(c.name) for c in schema.columns))

    def scan(self, name: str) -> DataFrame:
        """All rows, with their numbers in ``_row_idx``."""
        entry = self._table(name)
        return self._read(self.schema(name), entry["segments"])

    def get_all_rows(self, name: str) -> DataFrame:
        """All rows in the order of insertion."""
        return self.scan(name).orderBy(ROW_INDEX).drop(ROW_INDEX)

    def get_row(self, name: str, row: int) -> Row | None:
        entry = self._table(name)
        near = [s for s in entry["segments"] if s["first"] <= row < s["end"]]
        return self._read(self.schema(name), near).where(F.col(ROW_INDEX) == row).drop(ROW_INDEX).first() if near else None

    def get_row_by_key(self, name: str, key) -> Row | None:
        """The row of a primary key; none without a key column, for a null, and on a miss."""
        return self.rows_by_key(name, key).first()

    def rows_by_key(self, name: str, key) -> DataFrame:
        """As ``get_row_by_key``, as a table of one row or none. Only segments whose range of keys holds the key are read."""
        schema = self.schema(name)
        pk = schema.primary_key
        if pk is None or key is None or type_of(key) != pk.kind:
            return self._read(schema, []).drop(ROW_INDEX)
        return self._read(schema, self._near(name, key, key)).where(F.col(f"`{pk.name}`") == F.lit(key)).drop(ROW_INDEX)

    def row_count(self, name: str) -> int:
        return sum(s["end"] - s["first"] for s in self._table(name)["segments"])

    def rows_between(self, name: str, start: int, end: int) -> DataFrame:
        """Rows with numbers start to end - 1, in order; only their segments are read."""
        near = [s for s in self._table(name)["segments"] if s["first"] < end and start < s["end"]]
        return self._read(self.schema(name), near).where(F.col(ROW_INDEX).between(start, end - 1)).orderBy(ROW_INDEX)

    def _near(self, name: str, low, high) -> list[dict]:
        """The segments that may hold a key from low to high."""
        return [s for s in self._table(name)["segments"] if s.get("low") is None or not (s["high"] < low or high < s["low"])]

    def range_scan(self, name: str, start, end) -> DataFrame:
        """Rows with start <= key < end, in key order."""
        pk = self.schema(name).primary_key
        if pk is None:
            raise Unsupported(f"{name} has no key")
        key = F.col(f"`{pk.name}`")
        return self._read(self.schema(name), self._near(name, start, end)).where((key >= F.lit(start)) & (key < F.lit(end))).orderBy(key).drop(ROW_INDEX)

    def row_index(self, name: str, column: int | str) -> RowIndex:
        """An index of a column, for lookups and changes."""
        c = self.schema(name)[column]
        return RowIndex.of(self.scan(name), c.name, ROW_INDEX, c.kind)

    def index(self, name: str, column: int | str) -> DataFrame:
        """Each non-null value with the numbers of its rows in order."""
        return self.row_index(name, column).groups()

    # Writes

    def _staged(self, schema: TableSchema, df: DataFrame) -> tuple[str, DataFrame]:
        """The rows written once, so that checks and numbering read what is there; ``_q_id`` holds task and place."""
        keep = [c.name for c in schema.columns if c.kind != "NULL"]
        if not keep:
            raise Unsupported("a table of nulls alone")
        path = f"{self.root}/data/.{uuid.uuid4().hex}"
        df.select(F.monotonically_increasing_id().alias("_q_id"), *(F.col(f"`{c}`") for c in keep)).write.parquet(path)
        rows = self.spark.read.schema(T.StructType([T.StructField("_q_id", T.LongType()), *(f for f in schema.to_struct() if not isinstance(f.dataType, T.NullType))])).parquet(path)
        return path, rows.select("_q_id", *(F.col(f"`{c.name}`") if c.kind != "NULL" else F.lit(None).alias(c.name) for c in schema.columns))

    def _segments(self, schema: TableSchema, rows: DataFrame, first: int) -> tuple[list[dict], int]:
        """Staged rows with numbers from ``first`` on as segments, and the number after the last row."""
        rows, path = rows.withColumn("_q_part", F.shiftright("_q_id", 33)), uuid.uuid4().hex
        # One row for each partition that was written.
        counts = sorted((r["_q_part"], r["n"]) for r in rows.groupBy("_q_part").agg(F.count(F.lit(1)).alias("n")).collect())
        offsets, at = [], first
        for part, n in counts:
            offsets.append((part, at))
            at += n
        if not offsets:
            return [], at
        base = self.spark.createDataFrame(offsets, "_q_part long, _q_first long")
        number = (F.col("_q_first") + F.col("_q_id").bitwiseAND((1 << 33) - 1)).alias(ROW_INDEX)
        keep = [F.col(f"`{c.name}`") for c in schema.columns if c.kind != "NULL"]
        out = rows.join(F.broadcast(base), "_q_part").select(number, *keep)
        out = out.withColumn("_q_segment", F.floor((F.col(ROW_INDEX) - first) / SEGMENT_ROWS).cast("int"))
        pk = schema.primary_key
        out.sortWithinPartitions("_q_segment", f"`{pk.name}`" if pk else ROW_INDEX).write.partitionBy("_q_segment").parquet(f"{self.root}/data/{path}")
        bounds = {}
        if pk and pk.kind != "BLOB":
            # One row for each segment.
            key = F.col(f"`{pk.name}`")
            found = self.spark.read.schema(T.StructType([pk.to_field(), T.StructField("_q_segment", T.IntegerType())])).parquet(f"{self.root}/data/{path}")
            bounds = {r["_q_segment"]: (r["low"], r["high"]) for r in found.groupBy("_q_segment").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()}
        segments = []
        for k, start in enumerate(range(first, at, SEGMENT_ROWS)):
            low, high = bounds.get(k, (None, None))
            segments.append({"path": f"{path}/_q_segment={k}", "first": start, "end": min(at, start + SEGMENT_ROWS), "low": low, "high": high})
        return segments, at

    def _rows(self, schema: TableSchema, rows) -> DataFrame:
        if isinstance(rows, DataFrame):
            return schema.completed(rows)
        rows = [tuple(r) for r in rows]
        for r in rows:
            schema.validate_values(list(r))
        return self.spark.createDataFrame(rows, T.StructType([T.StructField(c.name, TYPES[c.kind], True) for c in schema.columns])).coalesce(1)

    def insert(self, name: str, rows, unique_columns: bool = False, references: bool = False) -> None:
        """Appends rows (a DataFrame or sequences of values) if all constraints hold; else nothing changes.

        Primary keys are held against those segments alone whose range of keys the new ones touch. ``unique_columns`` and
        ``references`` also hold UNIQUE columns and foreign keys to the whole tables.
        """
        entry, schema = self._table(name), self.schema(name)
        df = self._rows(schema, rows)
        schema.check_types(df)
        path, staged = self._staged(schema, df)
        try:
            new = staged.drop("_q_id")
            schema.validate(new)
            pk = schema.primary_key
            if entry["segments"] and unique_columns:
                schema.validate_keys(new, self.scan(name), True)
            elif entry["segments"] and pk:
                key = F.col(f"`{pk.name}`")
                low, high = new.agg(F.min(key), F.max(key)).first()
                near = self._near(name, low, high) if low is not None and pk.kind != "BLOB" else entry["segments"]
                old = self._read(schema, near)
                schema.validate_keys(new, old.where(key.between(F.lit(low), F.lit(high))) if near and pk.kind != "BLOB" and low is not None else old)
            else:
                schema.validate_keys(new, None, unique_columns)
            if references:
                schema.validate_references(new, {c.foreign_key.table: self.scan(c.foreign_key.table) for c in schema.columns if c.foreign_key})
            segments, end = self._segments(schema, staged, entry["next_row"])
        finally:
            self.files.delete(path)
        if segments:
            self._commit(self.tables | {name: entry | {"segments": [*entry["segments"], *segments], "next_row": end}})

    def set_cell(self, name: str, row: int, column: int | str, value) -> None:
        """Changes one value; the row's segment, of at most ``SEGMENT_ROWS`` rows, is written anew."""
        entry, schema = self._table(name), self.schema(name)
        c = schema[column]
        near = [s for s in entry["segments"] if s["first"] <= row < s["end"]]
        if not near:
            raise InvalidOperation(f"no row {row}")
        new = F.when(F.col(ROW_INDEX) == row, F.lit(value).cast(TYPES[c.kind])).otherwise(F.col(f"`{c.name}`"))
        old = self._read(schema, near)
        values = old.where(F.col(ROW_INDEX) == row).drop(ROW_INDEX).first()
        changed = [value if k == schema.index(column) else v for k, v in enumerate(values)]
        schema.validate_values(changed)
        schema.validate(self._rows(schema, [changed]))
        segment = near[0]
        if c.primary_key:
            others = self._read(schema, self._near(name, value, value) if c.kind != "BLOB" else entry["segments"])
            schema.validate_keys(self._rows(schema, [changed]), others.where(F.col(ROW_INDEX) != row))
            if segment.get("low") is not None:
                segment = segment | {"low": min(segment["low"], value), "high": max(segment["high"], value)}
        path = uuid.uuid4().hex
        out = old.withColumn(c.name, new)
        out.select(ROW_INDEX, *(F.col(f"`{x.name}`") for x in schema.columns if x.kind != "NULL")).sortWithinPartitions(f"`{schema.primary_key.name}`" if schema.primary_key else ROW_INDEX).write.parquet(f"{self.root}/data/{path}")
        segments = [segment | {"path": path} if s is near[0] else s for s in entry["segments"]]
        self._commit(self.tables | {name: entry | {"segments": segments}})

    def replace_rows(self, name: str, rows) -> None:
        """All rows anew, numbered from 0; also the way to delete."""
        entry, schema = self._table(name), self.schema(name)
        df = self._rows(schema, rows)
        schema.check_types(df)
        path, staged = self._staged(schema, df)
        try:
            schema.validate(staged.drop("_q_id"))
            schema.validate_keys(staged.drop("_q_id"))
            segments, end = self._segments(schema, staged, 0)
        finally:
            self.files.delete(path)
        self._commit(self.tables | {name: entry | {"segments": segments, "next_row": end}})

    def delete_by_key(self, name: str, key) -> None:
        """Removes a primary key's row; the others keep their order."""
        pk = self.schema(name).primary_key
        if pk is None:
            raise Unsupported(f"{name} has no key")
        self.replace_rows(name, self.get_all_rows(name).where(F.col(f"`{pk.name}`") != F.lit(key)))

    # Life cycle

    def checkpoint(self) -> None:
        """Removes data and manifests that the current version does not use."""
        used = {s["path"] for t in self.tables.values() for s in t["segments"]}
        for n in self.files.names(f"{self.root}/data"):
            if n in used:
                continue
            parts = [p for p in self.files.names(f"{self.root}/data/{n}") if p.startswith("_q_segment=")]
            unused = [p for p in parts if f"{n}/{p}" not in used]
            for p in [f"{n}/{p}" for p in unused] if len(unused) < len(parts) else [n]:
                self.files.delete(f"{self.root}/data/{p}")
        for n in self.files.names(f"{self.root}/manifests"):
            if n != f"{self.version:0{_DIGITS}d}":
                self.files.delete(f"{self.root}/manifests/{n}")

    def sync(self) -> None:
        """Commits are durable when they return."""

    def close(self) -> None:
        _LIVE.pop(self.holder, None)
        if not self.read_only and self._held().get("holder") == self.holder:
            self.files.delete(f"{self.root}/LOCK")


class MemoryCatalog(CatalogStore):
    """Tables' schemas alone, in memory; every operation on rows is unsupported."""

    def __init__(self):
        self.tables: dict[str, TableSchema] = {}

    def create_table(self, schema: TableSchema) -> None:
        if schema.name in self.tables:
            raise InvalidOperation(f"{schema.name} exists")
        self.tables[schema.name] = schema

    def drop_table(self, name: str) -> None:
        if self.tables.pop(name, None) is None:
            raise TableNotFound(name)

    def rename_table(self, old: str, new: str) -> None:
        if old not in self.tables:
            raise TableNotFound(old)
        if old != new and new in self.tables:
            raise InvalidOperation(f"{new} exists")
        self.tables[new] = TableSchema(new, self.tables.pop(old).columns)

    def schema(self, name: str) -> TableSchema:
        if name not in self.tables:
            raise TableNotFound(name)
        return self.tables[name]

    def catalog(self) -> dict[str, TableSchema]:
        return dict(self.tables)

    def _no_rows(self, *_):
        raise Unsupported("a catalog without rows")

    scan = get_all_rows = get_row = get_row_by_key = range_scan = insert = set_cell = replace_rows = _no_rows
