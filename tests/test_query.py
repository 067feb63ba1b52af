import pytest
from pyspark.sql import functions as F

from quarry import Query, query, query_project, registry
from quarry.errors import ColumnNotFound, InvalidOperation, TypeMismatch, Unsupported
from quarry.functions import aggregates
from quarry.functions.windows import over_partition


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(1, 11).select(F.col("id").alias("n"))


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(k, x) for k, x in enumerate([10, 20, 20, 30, 40])], "k long, x long")


def one(df):
    return df.first()["value"]


def test_filter_sort_limit_project(spark):
    users = spark.createDataFrame([(i, f"User{i}", i + 20) for i in range(10)], "id long, name string, age long")
    rows = Query(users).limit(3).filter("age >= 25").sort_by(F.col("age").desc()).rows()
    assert [r["age"] for r in rows] == [29, 28, 27]
    assert Query(users).limit(5).project("name").execute().count() == 5
    assert [r["id"] for r in Query(users).filter(lambda r: r["age"] > 27).sort_by("id").rows()] == [8, 9]


def test_limit_and_offset_do_not_depend_on_their_place(numbers):
    assert [r["n"] for r in Query(numbers).sort_by("n").limit(3).offset(4).rows()] == [5, 6, 7]
    assert [r["n"] for r in Query(numbers).offset(4).limit(9).limit(3).sort_by("n").rows()] == [5, 6, 7]
    assert Query(numbers).offset(50).rows() == []
    with pytest.raises(InvalidOperation):
        Query(numbers).limit(-1)


def test_two_sorts_are_one_with_the_first_leading(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (2, 2)], "a long, b long")
    assert [tuple(r) for r in Query(df).sort_by("a").sort_by(F.col("b").desc()).rows()] == [(1, 2), (1, 1), (2, 2), (2, 1)]


def test_equal_rows_keep_their_row_index(spark):
    df = spark.createDataFrame([(3, 1), (1, 1), (2, 1)], "_row_idx long, a long")
    assert [r["_row_idx"] for r in Query(df).sort_by("a").rows()] == [1, 2, 3]


def test_aggregates_by_name(numbers):
    q = Query(numbers).filter("n <= 5")
    assert [one(q.aggregate_by_name(f, "n")) for f in ("sum", "avg", "count", "min", "max", "median", "total")] == [15, 3.0, 5, 1, 5, 3.0, 15.0]
    with pytest.raises(Unsupported):
        q.aggregate_by_name("nothing", "n")


def test_aggregates_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([(None,), (5,), (None,), (7,)], "x long")
    assert one(Query(df).aggregate_by_name("sum", "x")) == 12
    assert one(Query(df).aggregate_by_name("count", "x")) == 4
    empty = Query(df.where("x > 100"))
    assert [one(empty.aggregate_by_name(f, "x")) for f in ("sum", "avg", "min", "median", "percentile_disc")] == [None] * 5
    assert one(empty.aggregate_by_name("count", "x")) == 0
    assert one(empty.aggregate_by_name("total", "x")) == 0.0


def test_sum_takes_integers_only_and_overflows(spark):
    with pytest.raises(TypeMismatch):
        Query(spark.createDataFrame([(1.5,)], "x double")).aggregate_by_name("sum", "x")
    big = spark.createDataFrame([(2**63 - 1,), (1,)], "x long")
    for f in ("sum", "avg"):
        with pytest.raises(Exception, match="OVERFLOW"):
            Query(big).aggregate_by_name(f, "x").collect()


def test_group_concat(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None), (4, "c")], "_row_idx long, s string")
    assert one(Query(df).aggregate(aggregates.group_concat(", "), "s")) == "a, b, c"
    assert one(Query(df.where("s is null")).aggregate_by_name("string_agg", "s")) == ""
    with pytest.raises(TypeMismatch):
        Query(df).aggregate_by_name("group_concat", "_row_idx")


def test_percentiles(spark):
    df = spark.createDataFrame([(x,) for x in range(1, 6)], "x long")
    assert one(Query(df).aggregate(aggregates.percentile_cont(0.25), "x")) == 2.0
    assert [one(Query(df).aggregate(aggregates.percentile_disc(p), "x")) for p in (0.0, 0.5, 0.61, 1.0)] == [1.0, 3.0, 4.0, 5.0]
    with pytest.raises(InvalidOperation):
        df.agg(aggregates.percentile_disc(0.5)(F.col("x") + 1, df.schema[0].dataType))
    assert one(Query(df).aggregate(aggregates.percentile_disc(0.5), F.col("x") + 1)) == 4.0
    with pytest.raises(InvalidOperation):
        aggregates.percentile_cont(1.5)(F.col("x"), df.schema[0].dataType)


def test_groups(spark):
    orders = spark.createDataFrame([(1, 100), (1, 200), (2, 150), (None, 1)], "c long, amount long")
    got = {r["c"]: r["s"] for r in Query(orders).group_by("c", s=("sum", "amount")).collect()}
    assert got == {1: 300, 2: 150, None: 1}
    assert {r["c"]: len(r["rows"]) for r in Query(orders).group_by("c").collect()} == {1: 2, 2: 1, None: 1}


def test_joins(spark):
    customers = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Eve"), (None, "Nobody")], "id long, name string")
    orders = spark.createDataFrame([(100, 1, 250), (101, 2, 500), (102, 1, 750), (103, None, 1)], "id long, customer_id long, amount long")
    inner = Query(orders).join_inner(customers, "customer_id", "id")
    assert inner.columns == ["id", "customer_id", "amount", "id_right", "name"]
    assert sorted(r["name"] for r in inner.collect()) == ["Alice", "Alice", "Bob", "Nobody"]
    left = Query(customers).join_left(orders, 3, "id", "customer_id").collect()
    assert [r["amount"] for r in left if r["name"] == "Eve"] == [None]
    with pytest.raises(InvalidOperation):
        Query(customers).join_left(orders, 2, "id", "customer_id")
    narrow = spark.createDataFrame([(1,)], "i smallint")
    assert [r["name"] for r in Query(customers).join_inner(narrow, "id", "i").collect()] == ["Alice"]
    other = spark.createDataFrame([(1.0,)], "d double")
    assert Query(customers).join_inner(other, "id", "d").count() == 0


def test_windows(values):
    def win(f, *args):
        order = ["x"] if f in ("rank", "dense_rank", "percent_rank", "cume_dist") else ["k"]
        return [r["value"] for r in Query(values).window(f, *args, order_by=order).orderBy("k").collect()]

    assert win("row_number") == [1, 2, 3, 4, 5]
    assert win("rank") == [1, 2, 2, 4, 5]
    assert win("dense_rank") == [1, 2, 2, 3, 4]
    assert win("percent_rank")[3] == 0.75
    assert win("cume_dist")[0] == 0.2 and win("cume_dist")[2] == 0.6
    assert win("ntile", 2) == [1, 1, 1, 2, 2]
    assert win("lag", "x", 1) == [None, 10, 20, 20, 30]
    assert win("lag", "x", 1, 999)[0] == 999 and win("lead", "x", 1, 888)[4] == 888
    assert win("first_value", "x") == [10] * 5 and win("last_value", "x") == [40] * 5
    assert win("nth_value", "x", 2) == [20] * 5 and win("nth_value", "x", 9) == [None] * 5
    for f, args in (("ntile", (0,)), ("nth_value", ("x", 0)), ("lag", ("x", -1)), ("lead", ("x", -1))):
        with pytest.raises(InvalidOperation):
            win(f, *args)


def test_windows_without_order(values):
    got = [Query(values).window(f).first()["value"] for f in ("rank", "dense_rank", "percent_rank", "cume_dist")]
    assert got == [1, 1, 0.0, 1.0]


def test_custom_functions(numbers, values):
    r = registry()
    r.register_scalar("thrice", lambda columns, kinds, **_: columns[0] * 3)
    assert Query(numbers).scalar("thrice", "n").agg(F.sum("value")).first()[0] == 165
    squares = aggregates.folded(F.lit(0.0), lambda a, x: a + (x * x).cast("double"))
    assert r.register_aggregate("squares", squares) is None
    assert r.register_aggregate("squares", squares) is squares
    assert one(Query(numbers).aggregate_by_name("squares", "n")) == 385.0
    r.register_window("rest", over_partition(lambda v, at: F.size(v) - at))
    assert [x["value"] for x in Query(values).window("rest", "x", order_by=["k"]).orderBy("k").collect()] == [5, 4, 3, 2, 1]
    assert len(r.names()["window"]) >= 11


def test_helpers_and_errors(numbers):
    assert [r["n"] for r in query(numbers, filter=["n > 2", "n < 9"], sort_by=F.col("n").desc(), limit=2).collect()] == [8, 7]
    assert [r["m"] for r in query_project(numbers, project="n * 2 as m", sort_by="n", limit=2).collect()] == [2, 4]
    with pytest.raises(InvalidOperation):
        query(numbers, having="n")
    with pytest.raises(ColumnNotFound):
        Query(numbers).filter("missing > 1").execute()
