"""Queries of the table store, indexes and constraints, with their SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from ..errors import ConstraintViolation, EngineError
from ..schema import CheckConstraint, ColumnDef, ForeignKey, TableSchema
from ..sources import MemoryCatalog, RowIndex, TableStore, Viewer, table

_LOCAL: list[str] = []


def _root(spark) -> str:
    """A fresh folder for a store in the folder that driver and executors share; a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a store needs a folder that executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="quarry-store-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


_CUSTOMERS = TableSchema(
    "customers",
    [
        ColumnDef("id", "INTEGER", primary_key=True),
        ColumnDef("name", "TEXT", nullable=False),
        ColumnDef("balance", "FLOAT", check=CheckConstraint("balance", ">", -100000.0)),
        ColumnDef("active", "BOOLEAN", default=True),
    ],
)


def _customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


def _filled(spark, d) -> TableStore:
    store = TableStore(spark, _root(spark))
    store.create_table(_CUSTOMERS)
    store.insert("customers", _customers(spark, d))
    return store


def store_roundtrip(spark, d):
    with _filled(spark, d) as store:
        return store.scan("customers").drop("_row_idx")


def store_lookup(spark, d):
    with _filled(spark, d) as store:
        return store.rows_by_key("customers", 77)


def store_get_row_by_key(spark, d):
    """Keys that are there, one that is not, and none."""
    with _filled(spark, d) as store:
        found = [store.get_row_by_key("customers", k) for k in (1, 42, -5, None)]
        return spark.createDataFrame([tuple(r) for r in found if r is not None], _CUSTOMERS.to_struct())


def _in_order(spark, d) -> TableStore:
    """Customers numbered in the order of their keys."""
    store = TableStore(spark, _root(spark))
    store.create_table(_CUSTOMERS)
    store.insert("customers", _customers(spark, d).orderBy("id"))
    return store


def store_get_row(spark, d):
    with _in_order(spark, d) as store:
        found = [store.get_row("customers", k) for k in (0, 10, 149, 10**9)]
        return spark.createDataFrame([tuple(r) for r in found if r is not None], _CUSTOMERS.to_struct())


def store_delete_by_key(spark, d):
    with _filled(spark, d) as store:
        store.delete_by_key("customers", 77)
        return store.scan("customers").drop("_row_idx")


def store_rename_and_drop(spark, d):
    with _filled(spark, d) as store:
        store.create_table(TableSchema("spare", [ColumnDef("id", "INTEGER")]))
        store.rename_table("customers", "clients")
        store.drop_table("spare")
        return store.scan("clients").select(F.lit(",".join(store.catalog())).alias("tables"), "id", "name")


def store_replace_table(spark, d):
    with _filled(spark, d) as store:
        store.replace_table("customers", TableSchema("customers", [ColumnDef("code", "INTEGER", primary_key=True), ColumnDef("label", "TEXT")]))
        store.insert("customers", _customers(spark, d).select(F.col("id").alias("code"), F.col("name").alias("label")).where("code <= 30").orderBy("code"))
        return store.scan("customers")


def store_reopen_after_crash(spark, d):
    """A store whose writer went without closing it is opened again; what was committed is there."""
    store = _filled(spark, d)
    root = store.root
    store.files.write(f"{root}/manifests/.unfinished", "{")
    del store
    with TableStore(spark, root) as store:
        store.insert("customers", [(-1, "late", 0.0, None)])
        return store.scan("customers").drop("_row_idx")


def store_checkpoint(spark, d):
    with _in_order(spark, d) as store:
        store.set_cell("customers", 3, "balance", 1.5)
        store.checkpoint()
        store.sync()
        root = store.root
    return TableStore(spark, root, read_only=True).scan("customers").drop("_row_idx")


def store_unique_and_references(spark, d):
    """Inserts that UNIQUE columns or foreign keys forbid change nothing."""
    with TableStore(spark, _root(spark)) as store:
        store.create_table(TableSchema("regions", [ColumnDef("id", "INTEGER", primary_key=True), ColumnDef("name", "TEXT", unique=True)]))
        store.create_table(TableSchema("nations", [ColumnDef("id", "INTEGER", primary_key=True), ColumnDef("region", "INTEGER", foreign_key=ForeignKey("regions", "id"))]))
        store.insert("regions", table(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")), unique_columns=True)
        nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("region"))
        store.insert("nations", nations.where("region < 3"), references=True)
        for name, rows, options in (("nations", nations.where("region >= 3"), {"references": True}), ("regions", [(9, "ASIA")], {"unique_columns": True})):
            try:
                store.insert(name, rows, **options)
            except ConstraintViolation:
                continue
            raise AssertionError(name)
        return store.scan("nations").drop("_row_idx")


def store_viewer(spark, d):
    with _in_order(spark, d) as store:
        return Viewer(store).rows("customers", 100, 20)


def catalog_describe(spark, d):
    with _filled(spark, d) as store:
        view = Viewer(TableStore(spark, store.root, read_only=True))
        return view.describe("customers").crossJoin(F.broadcast(view.tables().select("columns", "rows")))


def catalog_without_rows(spark, d):
    c = MemoryCatalog()
    for name in ("a", "b", "c"):
        c.create_table(TableSchema(name, [ColumnDef("id", "INTEGER", primary_key=True)]))
    c.rename_table("a", "z")
    c.drop_table("b")
    faults = []
    for act in (lambda: c.insert("z", [(1,)]), lambda: c.drop_table("b"), lambda: c.rename_table("c", "z")):
        try:
            act()
        except EngineError as e:
            faults.append(e.kind)
    return spark.createDataFrame([(",".join(sorted(c.catalog())), ",".join(faults))], "tables string, faults string")


def constraint_errors(spark, d):
    """The kind of error of each unfit insert: arity, strict types, null, check, allowed values, key twice, and of unfit names."""
    schema = TableSchema("t", [ColumnDef("id", "INTEGER", primary_key=True), ColumnDef("share", "FLOAT", check=CheckConstraint("share", "<=", 1.0)), ColumnDef("kind", "TEXT", allowed=["a", "b"])])
    with TableStore(spark, _root(spark)) as store:
        store.create_table(schema)
        store.insert("t", [(1, 0.5, "a")])
        tries = {
            "arity": lambda: store.insert("t", [(2, 0.5)]),
            "strict type": lambda: store.insert("t", [(2, 1, "a")]),
            "null key": lambda: store.insert("t", [(None, 0.5, "a")]),
            "check": lambda: store.insert("t", [(2, 1.5, "a")]),
            "allowed": lambda: store.insert("t", [(2, 0.5, "c")]),
            "key of another row": lambda: store.insert("t", [(1, 0.5, "a")]),
            "key twice": lambda: store.insert("t", [(3, 0.5, "a"), (3, 0.5, "b")]),
            "long name": lambda: TableSchema("x" * 256, [ColumnDef("id", "INTEGER")]),
            "no name": lambda: ColumnDef("", "INTEGER"),
            "same column": lambda: TableSchema("t", [ColumnDef("a", "TEXT"), ColumnDef("A", "TEXT")]),
            "no such column": lambda: store.set_cell("t", 0, "none", 1),
            "no such table": lambda: store.scan("none"),
        }
        out = []
        for name, act in tries.items():
            try:
                act()
                out.append((name, "none"))
            except EngineError as e:
                out.append((name, e.kind))
        return spark.createDataFrame([(*x, store.row_count("t")) for x in out], "name string, kind string, rows long")


def index_changes(spark, d):
    """An index of floats, minus zero as zero and nulls left out, after changes one by one."""
    rows = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, F.lit(-0.0)).when(F.col("c_custkey") % 5 == 1, F.lit(0.0)).when(F.col("c_custkey") % 5 == 2, F.lit(-2.5)).when(F.col("c_custkey") % 5 == 3, F.lit(1.5)).alias("k"), F.col("c_custkey").cast("long").alias("r"))
    index = RowIndex.of(rows, "k", "r", "FLOAT")
    for _ in range(2):
        index.insert(9.0, 7)
    index.insert(None, 8)
    index.insert(-0.0, 10**9)
    index.remove(1.5, 3)
    index.insert(4.0, 1)
    index.remove(4.0, 1)
    found = [index.contains(4.0), index.contains(9.0), index.lookup(9.0) == [7], index.lookup(None) is None]
    return index.groups().select("key", F.size("rows").cast("long").alias("n"), F.col("rows")[0].alias("first"), F.lit(all(x == y for x, y in zip(found, (False, True, True, True)))).alias("found"))


def index_delete(spark, d):
    """Range scan over keys in order, negative ones first, after one is deleted."""
    with TableStore(spark, _root(spark)) as store:
        store.create_table(TableSchema("f", [ColumnDef("k", "FLOAT", primary_key=True)]))
        store.insert("f", table(spark, d, "customer").select((F.col("c_custkey") - 75).cast("double").alias("k")))
        store.delete_by_key("f", -3.0)
        return store.range_scan("f", -6.0, 6.0)


def store_range_scan(spark, d):
    with _filled(spark, d) as store:
        return store.range_scan("customers", 100, 140)


def store_set_cell_all(spark, d):
    with _filled(spark, d) as store:
        row = store.scan("customers").where("id = 7").first()["_row_idx"]
        store.set_cell("customers", row, "name", "changed")
        return store.scan("customers").drop("_row_idx")


def store_replace(spark, d):
    with _filled(spark, d) as store:
        store.replace_rows("customers", _customers(spark, d).where("balance > 5000"))
        return store.scan("customers").select("id", "name", "balance")


def store_insert_twice(spark, d):
    with TableStore(spark, _root(spark)) as store:
        store.create_table(_CUSTOMERS)
        store.insert("customers", _customers(spark, d).where("id % 2 = 0"))
        store.insert("customers", _customers(spark, d).where("id % 2 = 1"))
        return store.scan("customers").agg(F.count(F.lit(1)).alias("n"), F.min("_row_idx").alias("first"), F.max("_row_idx").alias("last"), F.countDistinct("_row_idx").alias("numbers"))


def index_rows(spark, d):
    schema = TableSchema("nations", [ColumnDef("id", "INTEGER", primary_key=True), ColumnDef("region", "INTEGER")])
    with TableStore(spark, _root(spark)) as store:
        store.create_table(schema)
        store.insert("nations", table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("region")))
        return store.index("nations", "region").select("key", F.size("rows").cast("long").alias("n"))


def constraint_check(spark, d):
    schema = TableSchema(
        "checked",
        [
            ColumnDef("id", "INTEGER", primary_key=True),
            ColumnDef("segment", "TEXT", allowed=["BUILDING", "MACHINERY"]),
            ColumnDef("balance", "FLOAT", check=CheckConstraint("balance", ">=", 0.0)),
        ],
    )
    rows = table(spark, d, "customer").select(F.nullif("c_custkey", F.lit(5).cast("long")).alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    found = schema.violations(rows)
    return found.select(F.col("0_0_not_null").alias("nulls"), F.col("1_1_check").alias("segments"), F.col("2_1_check").alias("balances"))


_BASE = "select c_custkey as id, c_name as name, c_acctbal as balance, true as active from customer"
_ENTRIES = {
    "store_roundtrip": (store_roundtrip, _BASE),
    "store_lookup": (store_lookup, f"{_BASE} where c_custkey = 77"),
    "store_get_row_by_key": (store_get_row_by_key, f"{_BASE} where c_custkey in (1, 42)"),
    "store_get_row": (store_get_row, f"select id, name, balance, active from ({_BASE}) qualify row_number() over (order by id) in (1, 11, 150)"),
    "store_delete_by_key": (store_delete_by_key, f"{_BASE} where c_custkey <> 77"),
    "store_rename_and_drop": (store_rename_and_drop, "select 'clients' as tables, c_custkey as id, c_name as name from customer"),
    "store_replace_table": (store_replace_table, "select row_number() over (order by c_custkey) - 1 as _row_idx, c_custkey as code, c_name as label from customer where c_custkey <= 30"),
    "store_reopen_after_crash": (store_reopen_after_crash, f"{_BASE} union all select -1, 'late', 0.0, null"),
    "store_checkpoint": (store_checkpoint, f"select id, name, case when row_number() over (order by id) = 4 then 1.5 else balance end as balance, active from ({_BASE})"),
    "store_unique_and_references": (store_unique_and_references, "select cast(n_nationkey as bigint) as id, cast(n_regionkey as bigint) as region from nation where n_regionkey < 3"),
    "store_viewer": (store_viewer, f"select * from (select row_number() over (order by id) - 1 as _row_idx, * from ({_BASE})) where _row_idx >= 100 and _row_idx < 120"),
    "catalog_describe": (
        catalog_describe,
        "select *, 4 as columns, (select count(*) from customer) as rows from (values (0, 'id', 'INTEGER', true, false), (1, 'name', 'TEXT', false, false), (2, 'balance', 'FLOAT', false, true), (3, 'active', 'BOOLEAN', false, true)) v(place, name, kind, primary_key, nullable)",
    ),
    "catalog_without_rows": (catalog_without_rows, "select 'c,z' as tables, 'unsupported,invalid_operation,invalid_operation' as faults"),
    "constraint_errors": (
        constraint_errors,
        "select name, kind, cast(1 as bigint) as rows from (values ('arity', 'invalid_operation'), ('strict type', 'type_mismatch'), ('null key', 'constraint_violation'), ('check', 'constraint_violation'), ('allowed', 'constraint_violation'), ('key of another row', 'constraint_violation'), ('key twice', 'constraint_violation'), ('long name', 'invalid_operation'), ('no name', 'invalid_operation'), ('same column', 'invalid_operation'), ('no such column', 'invalid_operation'), ('no such table', 'invalid_operation')) v(name, kind)",
    ),
    "index_changes": (
        index_changes,
        "select key, count(*) as n, min(r) as first, true as found from (select case c_custkey % 5 when 0 then 0.0 when 1 then 0.0 when 2 then -2.5 when 3 then 1.5 end as key, cast(c_custkey as bigint) as r from customer union all values (9.0, 7), (0.0, 1000000000)) where key is not null and not (key = 1.5 and r = 3) group by 1",
    ),
    "index_delete": (index_delete, "select cast(c_custkey - 75 as double) as k from customer where c_custkey - 75 >= -6 and c_custkey - 75 < 6 and c_custkey <> 72"),
    "store_range_scan": (store_range_scan, f"{_BASE} where c_custkey >= 100 and c_custkey < 140"),
    "store_set_cell_all": (store_set_cell_all, f"select id, case when id = 7 then 'changed' else name end as name, balance, active from ({_BASE})"),
    "store_replace": (store_replace, "select c_custkey as id, c_name as name, c_acctbal as balance from customer where c_acctbal > 5000"),
    "store_insert_twice": (store_insert_twice, "select count(*) as n, cast(0 as bigint) as first, count(*) - 1 as last, count(*) as numbers from customer"),
    "index_rows": (index_rows, "select cast(n_regionkey as bigint) as key, count(*) as n from nation group by 1"),
    "constraint_check": (
        constraint_check,
        "select cast(sum(cast(c_custkey = 5 as int)) as bigint) as nulls, cast(sum(cast(c_mktsegment not in ('BUILDING', 'MACHINERY') as int)) as bigint) as segments, cast(sum(cast(c_acctbal < 0 as int)) as bigint) as balances from customer",
    ),
}


def queries() -> dict:
    return {k: v[0] for k, v in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _ENTRIES.items()}
