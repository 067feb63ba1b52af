import time

import pytest
from pyspark.sql import functions as F

import quarry.sources.store as store_module
from quarry import CheckConstraint, ColumnDef, ForeignKey, MemoryCatalog, RowIndex, TableSchema, TableStore, Viewer
from quarry.errors import CheckViolation, ColumnNotFound, ForeignKeyViolation, IndexOutOfBounds, InvalidOperation, Locked, NotNullViolation, TableNotFound, TypeMismatch, UniqueViolation, Unsupported


def people(**more):
    return TableSchema("people", [ColumnDef("id", "INTEGER", primary_key=True), ColumnDef("name", "TEXT", **more)])


def test_crud_and_reopen(spark, tmp_path):
    root = str(tmp_path / "store")
    with TableStore(spark, root) as store:
        store.create_table(people())
        store.insert("people", [(1, "Alice"), (2, "Bob")])
        store.insert("people", [(5, None)])
        with pytest.raises(UniqueViolation):
            store.insert("people", [(9, "x"), (1, "again")])
        assert [tuple(r) for r in store.get_all_rows("people").collect()] == [(1, "Alice"), (2, "Bob"), (5, None)]
        assert tuple(store.get_row("people", 2)) == (5, None) and store.get_row("people", 3) is None
        assert tuple(store.get_row_by_key("people", 2)) == (2, "Bob")
        assert store.get_row_by_key("people", None) is None and store.get_row_by_key("people", 77) is None
        store.set_cell("people", 0, "NAME", "Bobby")
        with pytest.raises(UniqueViolation):
            store.set_cell("people", 0, 0, 5)
        with pytest.raises(InvalidOperation):
            store.set_cell("people", 50, 0, 5)
        assert [r["id"] for r in store.range_scan("people", 1, 5).collect()] == [1, 2]
        with pytest.raises(Locked):
            TableStore(spark, root)
    with TableStore(spark, root) as store:
        assert [r["name"] for r in store.get_all_rows("people").collect()] == ["Bobby", "Bob", None]
        store.checkpoint()
        store.replace_rows("people", [(3, None), (4, None)])
        assert [tuple(r) for r in store.get_all_rows("people").collect()] == [(3, None), (4, None)]
        store.delete_by_key("people", 3)
        store.rename_table("people", "persons")
        assert store.get_all_rows("persons").count() == 1
        assert {r["key"]: r["rows"] for r in store.index("persons", 0).collect()} == {4: [0]}
        store.drop_table("persons")
        with pytest.raises(TableNotFound):
            store.scan("persons")


def test_a_dead_writers_lock_is_free(spark, tmp_path):
    root = str(tmp_path / "store")
    store = TableStore(spark, root)
    store.create_table(people())
    store.insert("people", [(1, "Alice")])
    with pytest.raises(Locked):
        TableStore(spark, root)
    reader = TableStore(spark, root, read_only=True)
    assert reader.get_all_rows("people").count() == 1
    with pytest.raises(Unsupported):
        reader.insert("people", [(2, "Bob")])
    del store  # as after a crash: nobody closes it
    with TableStore(spark, root) as again:
        again.insert("people", [(2, "Bob")])
        # Another host's writer whose lease runs out, and one whose lease has been taken.
        again.files.replace(f"{root}/LOCK", '{"holder": "x", "host": "elsewhere", "pid": 1, "time": %f}' % (time.time() - 10))
        with pytest.raises(Locked):
            TableStore(spark, root)
        with pytest.raises(Locked):
            again.insert("people", [(3, "Eve")])
        again.files.replace(f"{root}/LOCK", '{"holder": "x", "host": "elsewhere", "pid": 1, "time": 0}')
        with TableStore(spark, root) as last:
            assert last.get_all_rows("people").count() == 2
    reader.refresh()
    assert reader.get_all_rows("people").count() == 2


def test_segments_are_bounded_and_pruned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "SEGMENT_ROWS", 10)
    with TableStore(spark, str(tmp_path / "s")) as store:
        store.create_table(people())
        store.insert("people", spark.range(0, 35, numPartitions=3).select("id", F.concat(F.lit("n"), "id").alias("name")))
        parts = store.tables["people"]["segments"]
        assert [(s["first"], s["end"], s["low"], s["high"]) for s in parts] == [(0, 10, 0, 9), (10, 20, 10, 19), (20, 30, 20, 29), (30, 35, 30, 34)]
        assert store.get_row_by_key("people", 23)["name"] == "n23" and len(store._near("people", 23, 23)) == 1
        store.set_cell("people", 12, "id", 100)
        changed = store.tables["people"]["segments"]
        assert [a["path"] == b["path"] for a, b in zip(parts, changed)] == [True, False, True, True] and changed[1]["high"] == 100
        with pytest.raises(UniqueViolation):
            store.insert("people", [(100, "x")])
        store.checkpoint()
        assert sorted(r["id"] for r in store.scan("people").collect()) == sorted({*range(35), 100} - {12})
        assert store.row_count("people") == 35 and [r["id"] for r in store.range_scan("people", 9, 14).collect()] == [9, 10, 11, 13]


def test_unique_columns_and_references_on_request(spark, tmp_path):
    with TableStore(spark, str(tmp_path / "s")) as store:
        store.create_table(TableSchema("o", [ColumnDef("k", "INTEGER", primary_key=True)]))
        store.create_table(TableSchema("t", [ColumnDef("id", "INTEGER", primary_key=True), ColumnDef("name", "TEXT", unique=True), ColumnDef("o", "INTEGER", foreign_key=ForeignKey("o", "k"))]))
        store.insert("o", [(1,)])
        store.insert("t", [(1, "a", 1), (2, None, None)], unique_columns=True, references=True)
        with pytest.raises(UniqueViolation):
            store.insert("t", [(3, "a", 1)], unique_columns=True)
        with pytest.raises(ForeignKeyViolation):
            store.insert("t", [(3, "b", 9)], references=True)
        store.insert("t", [(3, "a", 9)])
        assert store.row_count("t") == 3


def test_row_index(spark):
    index = RowIndex(spark, "TEXT")
    assert index.lookup("a") is None and not index.contains("a")
    index.insert_all(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "key string, row long"))
    index.insert("a", 5)
    index.insert("c", 6)
    index.remove("b", 2)
    assert index.lookup("a") == [1, 5] and index.lookup("b") is None and index.contains("c") and index.lookup(None) is None
    assert {r["key"]: r["rows"] for r in index.groups().collect()} == {"a": [1, 5], "c": [6]}
    index.clear()
    assert index.entries().count() == 0
    with pytest.raises(TypeMismatch):
        RowIndex(spark, "NULL")


def test_viewer(spark, tmp_path):
    with TableStore(spark, str(tmp_path / "s")) as store:
        store.create_table(people())
        store.insert("people", [(k, None) for k in range(5)])
        view = Viewer(store)
        assert [tuple(r) for r in view.tables().collect()] == [("people", 2, 5)]
        assert [r["name"] for r in view.describe("people").collect()] == ["id", "name"]
        assert [r["id"] for r in view.rows("people", 3, 9).collect()] == [3, 4] and view.rows("people", 1, 0).count() == 0


def test_constraints(spark, tmp_path):
    with TableStore(spark, str(tmp_path / "s")) as store:
        store.create_table(
            TableSchema(
                "t",
                [
                    ColumnDef("id", "INTEGER", primary_key=True),
                    ColumnDef("age", "INTEGER", check=CheckConstraint("age", ">", 0)),
                    ColumnDef("kind", "TEXT", allowed=["a", "b"]),
                    ColumnDef("ratio", "FLOAT", nullable=False, default=1.0),
                    ColumnDef("data", "BLOB"),
                    ColumnDef("on", "BOOLEAN"),
                ],
            )
        )
        good = [(1, 5, "a", 0.5, b"x", True), (2, None, None, 0.5, None, None)]
        store.insert("t", good)
        for bad, error in (((3, 0, "a", 0.5, None, None), CheckViolation), ((3, 1, "c", 0.5, None, None), CheckViolation), ((3, 1, "a", None, None, None), NotNullViolation), ((3, 1, "a", 1, None, None), TypeMismatch), ((3, 1, "a", float("nan"), None, None), TypeMismatch), ((3, 1), InvalidOperation)):
            with pytest.raises(error):
                store.insert("t", [bad])
        assert store.get_all_rows("t").count() == 2
        store.insert("t", spark.createDataFrame([(7, "b")], "ID long, kind string"))
        assert store.get_row_by_key("t", 7)["ratio"] == 1.0


def test_check_kinds(spark):
    df = spark.createDataFrame([(True, bytearray(b"\x01"))], "b boolean, d binary")
    ok = [ColumnDef("b", "BOOLEAN", check=CheckConstraint("b", "=", True)), ColumnDef("d", "BLOB", check=CheckConstraint("d", "=", b"\x01"))]
    TableSchema("t", ok).validate(df)
    for bad in (ColumnDef("b", "BOOLEAN", check=CheckConstraint("b", ">=", True)), ColumnDef("b", "BOOLEAN", check=CheckConstraint("b", "=", 1))):
        with pytest.raises(CheckViolation):
            TableSchema("t", [bad, ok[1]]).validate(df)


def test_schema_rules(spark):
    with pytest.raises(InvalidOperation):
        TableSchema("t", [ColumnDef("a", "TEXT"), ColumnDef("A", "TEXT")])
    for name in ("", "x" * 256, "a\nb"):
        with pytest.raises(InvalidOperation):
            TableSchema(name, [ColumnDef("a", "TEXT")])
    s = TableSchema.from_json(people(foreign_key=ForeignKey("o", "k"), check=CheckConstraint("name", "=", "x"), allowed=["x"]).to_json())
    assert s["NAME"].foreign_key == ForeignKey("o", "k") and s["name"].check.value == "x" and not s["id"].nullable
    with pytest.raises(ColumnNotFound):
        s["none"]
    with pytest.raises(IndexOutOfBounds):
        s[9]
    with pytest.raises(ForeignKeyViolation):
        s.validate_references(spark.createDataFrame([(1, "q")], "id long, name string"), {"o": spark.createDataFrame([("x",)], "k string")})


def test_memory_catalog():
    c = MemoryCatalog()
    c.create_table(people())
    c.rename_table("people", "p")
    assert list(c.catalog()) == ["p"]
    with pytest.raises(Unsupported):
        c.insert("p", [])
    c.drop_table("p")
    with pytest.raises(TableNotFound):
        c.drop_table("p")
