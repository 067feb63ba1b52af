import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarry import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = plans.queries()[name](spark, SF), c.sql(plans.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    places = [want.columns.index(n) for n in names]
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[p]) for p in places) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_a_cell_is_set_in_a_whole_table(spark):
    found = plans.queries()["store_set_cell_all"](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/customer.parquet").count() > 50 and found.where("name = 'changed'").count() == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["sort_multi_key_all", "project_then_filter_all"])
def test_whole_tables_are_sorted(spark, name):
    found = plans.queries()[name](spark, SF)
    assert "TakeOrdered" not in found._jdf.queryExecution().executedPlan().toString()
    places = [tuple(r) for r in found.collect()]
    key = (lambda r: (r[1], -r[2], r[0])) if name == "sort_multi_key_all" else (lambda r: (-r[2], r[0]))
    assert places and places == sorted(places, key=key)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
