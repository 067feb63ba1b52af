"""Queries of the relational operators, aggregates and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import FunctionRegistry, aggregates, registry
from ..functions.windows import over_partition
from ..operators import Query, query, query_project
from ..sources import table


def _q(spark, folder, name):
    return Query(table(spark, folder, name))


def scan_filter(spark, d):
    return _q(spark, d, "orders").filter(F.col("o_totalprice") >= 200000.0).project("o_orderkey", "o_custkey", "o_totalprice").execute()


def filter_multi(spark, d):
    return _q(spark, d, "lineitem").filter("l_quantity > 25").filter(F.col("l_discount") <= 0.05).filter("l_returnflag = 'R'").project("l_orderkey", "l_linenumber", "l_quantity").execute()


def sort_multi_key_all(spark, d):
    return _q(spark, d, "customer").sort_by(F.col("c_mktsegment")).sort_by(F.col("c_acctbal").desc()).sort_by("c_custkey").project("c_custkey", "c_mktsegment", "c_acctbal").execute()


def topk(spark, d):
    return _q(spark, d, "orders").limit(20).filter(F.col("o_totalprice") >= 1000.0).offset(5).sort_by(F.col("o_totalprice").desc(), F.col("o_orderkey")).project("o_orderkey", "o_custkey", "o_totalprice").execute()


def offset_limit(spark, d):
    return query_project(table(spark, d, "part"), project=["p_partkey", "p_name"], limit=50, offset=100, sort_by="p_partkey")


def project_expr(spark, d):
    return _q(spark, d, "lineitem").project("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net")).execute()


def project_then_filter_all(spark, d):
    return _q(spark, d, "customer").project("c_custkey", "c_nationkey", (F.col("c_acctbal") * 2).alias("twice")).filter("twice > 9000").sort_by(F.col("twice").desc(), "c_custkey").execute()


def query_helper(spark, d):
    return query(table(spark, d, "nation"), filter="n_regionkey = 1", sort_by=[F.col("n_name").desc()], limit=3)


def _small(spark, d):
    """Line numbers with nulls among them."""
    return _q(spark, d, "lineitem").project(F.nullif(F.col("l_linenumber").cast("long"), F.lit(3).cast("long")).alias("x"), "l_returnflag")


def _agg(function):
    return lambda spark, d: _small(spark, d).aggregate_by_name(function, "x", "value")


def agg_total(spark, d):
    return _q(spark, d, "lineitem").project(F.nullif("l_quantity", F.lit(7.0)).alias("x")).aggregate_by_name("total", "x")


def agg_after_limit(spark, d):
    return _q(spark, d, "orders").sort_by("o_orderkey").offset(10).limit(100).aggregate_by_name("sum", "o_custkey")


def _percentile(build):
    return lambda spark, d: _q(spark, d, "lineitem").aggregate(build, "l_extendedprice")


def agg_group_concat(spark, d):
    return _q(spark, d, "nation").group_by("n_regionkey", names=("group_concat", "n_name", "n_name"))


def agg_string_agg(spark, d):
    return _q(spark, d, "region").group_by((F.col("r_regionkey") % 2).alias("parity"), names=(aggregates.group_concat("-"), "r_name", "r_name"))


def group_by_sum(spark, d):
    return _q(spark, d, "orders").group_by("o_custkey", orders=("count", "o_orderkey"), keys=("sum", "o_orderkey"), most=("max", "o_totalprice"), least=("min", "o_totalprice"))


def group_by_null_key(spark, d):
    return _small(spark, d).group_by("x", n=("count", "x"), mean=("avg", "x"))


def group_by_collect(spark, d):
    out = _q(spark, d, "orders").project("o_custkey", "o_orderkey").group_by("o_custkey")
    return out.select("o_custkey", F.size("rows").cast("long").alias("n"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["o_orderkey"]).alias("keys"))


def group_by_revenue(spark, d):
    q = _q(spark, d, "lineitem").project("l_returnflag", "l_linestatus", "l_quantity", F.col("l_linenumber").cast("long").alias("line"))
    return q.group_by("l_returnflag", "l_linestatus", quantity=("total", "l_quantity"), lines=("avg", "line"), n=("count", "line"))


def join_inner(spark, d):
    return _q(spark, d, "orders").project("o_orderkey", "o_custkey").join_inner(table(spark, d, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey")


def join_left(spark, d):
    right = table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey", "o_orderkey")
    return _q(spark, d, "customer").project("c_custkey", "c_nationkey").join_left(right, 2, "c_custkey", "o_custkey")


def join_null_safe(spark, d):
    left = _q(spark, d, "nation").project("n_nationkey", F.nullif("n_regionkey", F.lit(2)).alias("k"))
    right = table(spark, d, "region").select(F.nullif("r_regionkey", F.lit(2)).alias("rk"), "r_name")
    return left.join_inner(right, "k", "rk")


def join_after_filter(spark, d):
    left = _q(spark, d, "orders").filter("o_totalprice > 250000").sort_by(F.col("o_totalprice").desc(), "o_orderkey").limit(200)
    return left.project("o_orderkey", "o_custkey").join_inner(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "o_custkey", "c_custkey")


def join_type_mismatch(spark, d):
    """Keys of different types are never equal."""
    return _q(spark, d, "nation").project("n_nationkey", "n_regionkey").join_left(table(spark, d, "region").select(F.col("r_regionkey").cast("double").alias("rk"), "r_name"), 2, "n_regionkey", "rk")


def join_int_widths(spark, d):
    """All integers are one kind of key."""
    left = _q(spark, d, "customer").project("c_custkey", F.col("c_nationkey").cast("bigint").alias("k"))
    return left.join_inner(table(spark, d, "nation").select(F.col("n_nationkey").cast("smallint").alias("nk"), "n_name"), "k", "nk")


def join_float_widths(spark, d):
    """So are both floating point types."""
    left = _q(spark, d, "nation").project("n_nationkey", (F.col("n_regionkey") * 0.5).cast("float").alias("k"))
    return left.join_left(table(spark, d, "region").where("r_regionkey > 1").select((F.col("r_regionkey") * 0.5).cast("double").alias("rk"), "r_name"), 2, "k", "rk").withColumn("k", F.col("k").cast("double"))


def registry_names(spark, d):
    """Numbers of functions of a fresh registry, before and after one is registered."""
    r = FunctionRegistry()
    before = {k: len(v) for k, v in r.names().items()}
    r.register_scalar("own", lambda columns, kinds, **_: columns[0])
    return spark.createDataFrame([(k, before[k], len(v)) for k, v in r.names().items()], "kind string, known long, own long")


def exported_names(spark, d):
    """What the package offers by name."""
    import quarry

    return spark.createDataFrame([(n,) for n in ("Query", "query", "query_project", "registry", "FunctionRegistry") if hasattr(quarry, n)], "name string")


def _win(function, *args, cast=None):
    def run(spark, d):
        q = _q(spark, d, "orders").project("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
        order = ["day", "o_orderkey"] if function in ("row_number", "ntile", "lag", "lead", "first_value", "last_value", "nth_value") else [F.weekday("day")]
        out = q.window(function, *args, partition_by=["o_custkey"], order_by=order)
        return out.select("o_orderkey", (F.col("value").cast(cast) if cast else F.col("value")).alias("value"))

    return run


def udf_scalar_custom(spark, d):
    registry().register_scalar("twice_plus_one", lambda columns, kinds, **_: columns[0] * 2 + 1)
    return _q(spark, d, "supplier").project("s_suppkey").scalar("twice_plus_one", "s_suppkey")


def _squares():
    return aggregates.combined(lambda x: (x * x).cast("double"), F.sum, lambda total: F.coalesce(total, F.lit(0.0)))


def udaf_sum_squares(spark, d):
    registry().register_aggregate("sum_squares", _squares())
    return _q(spark, d, "orders").project("o_custkey", (F.col("o_orderkey") % 100).alias("x")).group_by("o_custkey", value=("sum_squares", "x"))


def udwf_custom(spark, d):
    """Distance of each order from its customer's first, by a user's window function."""
    registry().register_window("from_first", over_partition(lambda values, at: F.get(values, at) - F.get(values, F.lit(0))))
    q = _q(spark, d, "orders").project("o_custkey", "o_orderkey")
    return q.window("from_first", "o_orderkey", partition_by=["o_custkey"], order_by=["o_orderkey"])


_X = "nullif(cast(l_linenumber as bigint), 3)"
_WIN = "select o_orderkey, {f} as value from (select *, cast(o_orderdate as date) as day from orders) w"
_ROWS = "over (partition by o_custkey order by day, o_orderkey)"
_FULL = "over (partition by o_custkey order by day, o_orderkey rows between unbounded preceding and unbounded following)"
_DAYS = "over (partition by o_custkey order by isodow(day))"

_ENTRIES = {
    "scan_filter": (scan_filter, "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice >= 200000"),
    "filter_multi": (filter_multi, "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 25 and l_discount <= 0.05 and l_returnflag = 'R'"),
    "sort_multi_key_all": (sort_multi_key_all, "select c_custkey, c_mktsegment, c_acctbal from customer order by c_mktsegment, c_acctbal desc, c_custkey"),
    "topk": (topk, "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice >= 1000 order by o_totalprice desc, o_orderkey limit 20 offset 5"),
    "offset_limit": (offset_limit, "select p_partkey, p_name from part order by p_partkey limit 50 offset 100"),
    "project_expr": (project_expr, "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem"),
    "project_then_filter_all": (project_then_filter_all, "select c_custkey, c_nationkey, c_acctbal * 2 as twice from customer where c_acctbal * 2 > 9000 order by twice desc, c_custkey"),
    "query_helper": (query_helper, "select * from nation where n_regionkey = 1 order by n_name desc limit 3"),
    "agg_count_with_nulls": (_agg("count"), f"select count(*) as value from (select {_X} as x from lineitem)"),
    "agg_sum_int": (_agg("sum"), f"select cast(sum({_X}) as bigint) as value from lineitem"),
    "agg_avg_int": (_agg("avg"), f"select cast(sum({_X}) as double) / count({_X}) as value from lineitem"),
    "agg_min": (_agg("min"), f"select min({_X}) as value from lineitem"),
    "agg_max": (_agg("max"), f"select max({_X}) as value from lineitem"),
    "agg_total": (agg_total, "select coalesce(sum(nullif(l_quantity, 7.0)), 0.0) as value from lineitem"),
    "agg_after_limit": (agg_after_limit, "select cast(sum(o_custkey) as bigint) as value from (select o_custkey from orders order by o_orderkey limit 100 offset 10)"),
    "agg_median": (_percentile(aggregates.median), "select median(l_extendedprice) as value from lineitem"),
    "agg_percentile_cont": (_percentile(aggregates.percentile_cont(0.25)), "select quantile_cont(l_extendedprice, 0.25) as value from lineitem"),
    "agg_percentile_disc": (_agg("percentile_disc"), f"select cast(quantile_disc({_X}, 0.5) as double) as value from lineitem"),
    "agg_group_concat": (agg_group_concat, "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by 1"),
    "agg_string_agg": (agg_string_agg, "select r_regionkey % 2 as parity, string_agg(r_name, '-' order by r_name) as names from region group by 1"),
    "group_by_sum": (group_by_sum, "select o_custkey, count(*) as orders, cast(sum(o_orderkey) as bigint) as keys, max(o_totalprice) as most, min(o_totalprice) as least from orders group by 1"),
    "group_by_null_key": (group_by_null_key, f"select x, count(*) as n, cast(sum(x) as double) / nullif(count(x), 0) as mean from (select {_X} as x from lineitem) group by 1"),
    "group_by_collect": (group_by_collect, "select o_custkey, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders group by 1"),
    "group_by_revenue": (group_by_revenue, "select l_returnflag, l_linestatus, sum(l_quantity) as quantity, cast(sum(l_linenumber) as double) / count(*) as lines, count(*) as n from lineitem group by 1, 2"),
    "join_inner": (join_inner, "select o_orderkey, o_custkey, c_custkey, c_name from orders join customer on o_custkey = c_custkey"),
    "join_left": (join_left, "select c_custkey, c_nationkey, o_custkey, o_orderkey from customer left join (select o_custkey, o_orderkey from orders where o_totalprice > 300000) on c_custkey = o_custkey"),
    "join_null_safe": (join_null_safe, "select n_nationkey, k, rk, r_name from (select n_nationkey, nullif(n_regionkey, 2) as k from nation) join (select nullif(r_regionkey, 2) as rk, r_name from region) on k is not distinct from rk"),
    "join_after_filter": (join_after_filter, "select o_orderkey, o_custkey, c_custkey, c_mktsegment from (select o_orderkey, o_custkey from orders where o_totalprice > 250000 order by o_totalprice desc, o_orderkey limit 200) join customer on o_custkey = c_custkey"),
    "join_type_mismatch": (join_type_mismatch, "select n_nationkey, n_regionkey, cast(null as double) as rk, cast(null as varchar) as r_name from nation"),
    "join_int_widths": (join_int_widths, "select c_custkey, cast(c_nationkey as bigint) as k, cast(n_nationkey as smallint) as nk, n_name from customer join nation on c_nationkey = n_nationkey"),
    "join_float_widths": (join_float_widths, "select n_nationkey, n_regionkey * 0.5::double as k, rk, r_name from nation left join (select r_regionkey * 0.5::double as rk, r_name from region where r_regionkey > 1) on n_regionkey * 0.5::double = rk"),
    "registry_names": (registry_names, "select * from (values ('scalar', cast(41 as bigint), cast(42 as bigint)), ('aggregate', 11, 11), ('window', 11, 11)) v(kind, known, own)"),
    "exported_names": (exported_names, "select unnest(['Query', 'query', 'query_project', 'registry', 'FunctionRegistry']) as name"),
    "win_row_number": (_win("row_number"), _WIN.format(f=f"row_number() {_ROWS}")),
    "win_rank": (_win("rank", cast="long"), _WIN.format(f=f"rank() {_DAYS}")),
    "win_dense_rank": (_win("dense_rank", cast="long"), _WIN.format(f=f"dense_rank() {_DAYS}")),
    "win_percent_rank": (_win("percent_rank"), _WIN.format(f=f"percent_rank() {_DAYS}")),
    "win_cume_dist": (_win("cume_dist"), _WIN.format(f=f"cume_dist() {_DAYS}")),
    "win_ntile": (_win("ntile", 3), _WIN.format(f=f"ntile(3) {_ROWS}")),
    "win_lag": (_win("lag", "o_totalprice", 1), _WIN.format(f=f"lag(o_totalprice) {_ROWS}")),
    "win_lead": (_win("lead", "o_totalprice", 2, -1.0), _WIN.format(f=f"lead(o_totalprice, 2, -1.0) {_ROWS}")),
    "win_first_value": (_win("first_value", "o_totalprice"), _WIN.format(f=f"first_value(o_totalprice) {_FULL}")),
    "win_last_value": (_win("last_value", "o_totalprice"), _WIN.format(f=f"last_value(o_totalprice) {_FULL}")),
    "win_nth_value": (_win("nth_value", "o_totalprice", 2), _WIN.format(f=f"nth_value(o_totalprice, 2) {_FULL}")),
    "udf_scalar_custom": (udf_scalar_custom, "select s_suppkey, s_suppkey * 2 + 1 as value from supplier"),
    "udaf_sum_squares": (udaf_sum_squares, "select o_custkey, cast(sum((o_orderkey % 100) * (o_orderkey % 100)) as double) as value from orders group by 1"),
    "udwf_custom": (udwf_custom, "select o_custkey, o_orderkey, o_orderkey - first_value(o_orderkey) over (partition by o_custkey order by o_orderkey) as value from orders"),
}


def queries() -> dict:
    return {k: v[0] for k, v in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _ENTRIES.items()}
