"""Declared table schemas: columns with constraints, their validation, and how they map to Spark's."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import CheckViolation, ColumnNotFound, ForeignKeyViolation, IndexOutOfBounds, InvalidOperation, NotNullViolation, TypeMismatch, UniqueViolation

MAX_NAME_BYTES, MAX_COLUMNS, MAX_TABLES = 255, 1024, 1024
MAX_TEXT_BYTES, MAX_BLOB_BYTES = 16 * 1024 * 1024, 64 * 1024 * 1024
FLOAT_EPSILON = 1e-12

TYPES: dict[str, T.DataType] = {
    "NULL": T.NullType(),
    "INTEGER": T.LongType(),
    "FLOAT": T.DoubleType(),
    "TEXT": T.StringType(),
    "BLOB": T.BinaryType(),
    "BOOLEAN": T.BooleanType(),
}
OPERATORS = ("=", "!=", "<", "<=", ">", ">=")


def type_of(value: Any) -> str:
    """Type name of a Python value."""
    if value is None:
        return "NULL"
    for kind, name in ((bool, "BOOLEAN"), (int, "INTEGER"), (float, "FLOAT"), (str, "TEXT"), ((bytes, bytearray), "BLOB")):
        if isinstance(value, kind):
            return name
    raise TypeMismatch(f"no type for {type(value).__name__}")


def check_name(name: str, what: str = "name") -> str:
    """A usable table or column name."""
    if not name:
        raise InvalidOperation(f"{what} is empty")
    if len(name.encode()) > MAX_NAME_BYTES:
        raise InvalidOperation(f"{what} is longer than {MAX_NAME_BYTES} bytes")
    if any(ord(c) < 32 or 127 <= ord(c) < 160 for c in name):
        raise InvalidOperation(f"{what} holds control characters")
    return name


@dataclass(frozen=True)
class CheckConstraint:
    """Column against a literal. Values of another type fail; blobs and booleans know = and != only."""

    column: str
    op: str
    value: Any

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise InvalidOperation(f"unknown operator {self.op}")

    def holds(self, column: Column, kind: str) -> Column:
        if type_of(self.value) != kind or (kind in ("BLOB", "BOOLEAN") and self.op not in ("=", "!=")):
            return F.lit(False)
        v = F.lit(self.value)
        if kind == "FLOAT" and self.op in ("=", "!="):
            near = F.abs(column - v) < F.lit(FLOAT_EPSILON)
            return near if self.op == "=" else ~near
        return {"=": column == v, "!=": column != v, "<": column < v, "<=": column <= v, ">": column > v, ">=": column >= v}[self.op]


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str


@dataclass
class ColumnDef:
    """A column. A primary key is unique and not null, whatever else is asked."""

    name: str
    kind: str
    nullable: bool = True
    primary_key: bool = False
    unique: bool = False
    default: Any = None
    check: CheckConstraint | None = None
    foreign_key: ForeignKey | None = None
    allowed: list = field(default_factory=list)

    def __post_init__(self):
        check_name(self.name, "column name")
        if self.kind not in TYPES:
            raise TypeMismatch(f"unknown type {self.kind}")
        if self.primary_key:
            self.nullable, self.unique = False, True

    def to_field(self) -> T.StructField:
        return T.StructField(self.name, TYPES[self.kind], self.nullable)

    def faults(self) -> list[tuple[str, Column]]:
        """(violation, predicate of a violating row): null, then size and finiteness, then check, then allowed values."""
        c, out = F.col(f"`{self.name}`"), []
        if not self.nullable:
            out.append(("not_null", c.isNull()))
        if self.kind == "FLOAT":
            out.append(("type", F.isnan(c) | (F.abs(c) == F.lit(float("inf")))))
        if self.kind in ("TEXT", "BLOB"):
            out.append(("type", F.octet_length(c) > (MAX_TEXT_BYTES if self.kind == "TEXT" else MAX_BLOB_BYTES)))
        if self.kind == "NULL":
            out.append(("type", c.isNotNull()))
        if self.check is not None:
            out.append(("check", c.isNotNull() & ~self.check.holds(c, self.kind)))
        if self.allowed:
            same = [F.lit(v) for v in self.allowed if type_of(v) == self.kind]
            out.append(("check", c.isNotNull() & (~c.isin(same) if same else F.lit(True))))
        return [(k, F.coalesce(p, F.lit(False))) for k, p in out]


class TableSchema:
    """A named list of columns; names are unique whatever their case."""

    def __init__(self, name: str, columns: list[ColumnDef]):
        self.name, self.columns = check_name(name, "table name"), list(columns)
        if not 1 <= len(self.columns) <= MAX_COLUMNS:
            raise InvalidOperation(f"a table has 1 to {MAX_COLUMNS} columns")
        low = [c.name.lower() for c in self.columns]
        if len(set(low)) < len(low):
            raise InvalidOperation("column names repeat")

    def index(self, column: int | str) -> int:
        """Place of a column by number or, whatever its case, by name."""
        if isinstance(column, int):
            if not 0 <= column < len(self.columns):
                raise IndexOutOfBounds(f"column {column} of {len(self.columns)}")
            return column
        for k, c in enumerate(self.columns):
            if c.name.lower() == column.lower():
                return k
        raise ColumnNotFound(column)

    def __getitem__(self, column: int | str) -> ColumnDef:
        return self.columns[self.index(column)]

    @property
    def primary_key(self) -> ColumnDef | None:
        return next((c for c in self.columns if c.primary_key), None)

    def to_struct(self) -> T.StructType:
        return T.StructType([c.to_field() for c in self.columns])

    def validate_values(self, values: list) -> None:
        """Arity and types of one row's Python values; other constraints are checked by ``validate``."""
        if len(values) != len(self.columns):
            raise InvalidOperation(f"{len(values)} values for {len(self.columns)} columns")
        for c, v in zip(self.columns, values):
            if v is None and not c.nullable:
                raise NotNullViolation(c.name)
            if v is not None and type_of(v) != c.kind:
                raise TypeMismatch(f"{c.name}: {type_of(v)} for {c.kind}")

    def completed(self, df: DataFrame) -> DataFrame:
        """The rows in the schema's order; a column left out gets its default."""
        have = {c.lower(): c for c in df.columns}
        unknown = set(have) - {c.name.lower() for c in self.columns}
        if unknown:
            raise ColumnNotFound(", ".join(sorted(unknown)))
        out = []
        for c in self.columns:
            own = have.get(c.name.lower())
            out.append(F.col(f"`{own}`").alias(c.name) if own else F.lit(c.default).cast(TYPES[c.kind]).alias(c.name))
        return df.select(*out)

    def check_types(self, df: DataFrame) -> None:
        if len(df.columns) != len(self.columns):
            raise InvalidOperation(f"{len(df.columns)} columns for {len(self.columns)}")
        for c, f in zip(self.columns, df.schema.fields):
            if f.dataType != TYPES[c.kind] and not isinstance(f.dataType, T.NullType):
                raise TypeMismatch(f"{c.name}: {f.dataType.simpleString()} for {c.kind}")

    def violations(self, df: DataFrame) -> DataFrame:
        """One row: the number of rows that violate each constraint (column <number>_<kind>). One pass, no shuffle of rows."""
        sums = [F.coalesce(F.sum(p.cast("long")), F.lit(0)).alias(f"{k}_{i}_{kind}") for k, c in enumerate(self.columns) for i, (kind, p) in enumerate(c.faults())]
        return df.agg(*(sums or [F.lit(0).cast("long").alias("none")]))

    def validate(self, df: DataFrame) -> None:
        """Raises for the first violated constraint, in column order."""
        self.check_types(df)
        for name, n in self.violations(df).first().asDict().items():
            if n:
                k, _, kind = name.split("_", 2)
                kinds = {"not_null": NotNullViolation, "type": TypeMismatch, "check": CheckViolation}
                raise kinds[kind](f"{self.columns[int(k)].name}: {n} rows")

    def validate_keys(self, new: DataFrame, existing: DataFrame | None = None, unique_columns: bool = False) -> None:
        """No value of the primary key (and of UNIQUE columns, if asked) comes twice; nulls may."""
        for c in self.columns:
            if not (c.primary_key or (unique_columns and c.unique)):
                continue
            own = new.select(F.col(f"`{c.name}`").alias("k")).where("k is not null")
            if own.groupBy("k").count().where("count > 1").limit(1).count():
                raise UniqueViolation(c.name)
            if existing is not None:
                old = existing.select(F.col(f"`{c.name}`").alias("k"))
                if own.join(old, "k", "left_semi").limit(1).count():
                    raise UniqueViolation(c.name)

    def validate_references(self, new: DataFrame, tables: dict[str, DataFrame]) -> None:
        """Every non-null foreign key is found in its table."""
        for c in self.columns:
            if c.foreign_key:
                other = tables[c.foreign_key.table].select(F.col(f"`{c.foreign_key.column}`").alias("k"))
                own = new.select(F.col(f"`{c.name}`").alias("k")).where("k is not null")
                if own.join(other, "k", "left_anti").limit(1).count():
                    raise ForeignKeyViolation(c.name)

    def to_json(self) -> str:
        def plain(v):
            return {"blob": v.hex()} if isinstance(v, (bytes, bytearray)) else v

        columns = []
        for c in self.columns:
            d = {"name": c.name, "kind": c.kind, "nullable": c.nullable, "primary_key": c.primary_key, "unique": c.unique, "default": plain(c.default), "allowed": [plain(v) for v in c.allowed]}
            d["check"] = [c.check.column, c.check.op, plain(c.check.value)] if c.check else None
            d["foreign_key"] = [c.foreign_key.table, c.foreign_key.column] if c.foreign_key else None
            columns.append(d)
        return json.dumps({"name": self.name, "columns": columns})

    @classmethod
    def from_json(cls, text: str) -> TableSchema:
        def value(v):
            return bytes.fromhex(v["blob"]) if isinstance(v, dict) else v

        d, columns = json.loads(text), []
        for c in d["columns"]:
            check = CheckConstraint(c["check"][0], c["check"][1], value(c["check"][2])) if c["check"] else None
            foreign = ForeignKey(*c["foreign_key"]) if c["foreign_key"] else None
            columns.append(ColumnDef(c["name"], c["kind"], c["nullable"], c["primary_key"], c["unique"], value(c["default"]), check, foreign, [value(v) for v in c["allowed"]]))
        return cls(d["name"], columns)
