"""Queries of the scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry
from ..sources import table


def _columns(name, keys, **calls):
    """A query of keys and scalar calls: out=(function, arguments, options[, rounding])."""

    def run(spark, d):
        df, out = table(spark, d, name), []
        for alias, (function, args, *rest) in calls.items():
            options, digits = (rest + [{}, None])[0] if rest else {}, rest[1] if len(rest) > 1 else None
            c = registry().scalar(df, function, *(F.expr(a) for a in args), **options)
            out.append((F.round(c, digits) if digits is not None else c).alias(alias))
        return df.select(*keys, *out)

    return run


def _math(name, key, **calls):
    return _columns(name, [key], **{alias: (f, args, {}, 9) for alias, (f, args) in calls.items()})


_S = "(s_acctbal / 10000.0)"
_Q = "(l_quantity / 10.0)"


def _finite(x: str) -> str:
    return f"round(case when isfinite({x}) then {x} end, 9)"


def _sql(name, key, **calls):
    return f"select {key}, " + ", ".join(f"{v} as {k}" for k, v in calls.items()) + f" from {name}"


_L = "l_orderkey, l_linenumber"
_D = "cast(cast(o_orderdate as date) as varchar)"
_TS = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"
_TEXT = "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')"
_DAY = "date_format(o_orderdate, 'yyyy-MM-dd')"
_EVENT = "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS')"


def _time(name, key, **calls):
    return _columns(name, [key], **calls)


_ENTRIES = {
    "str_upper": (_columns("customer", ["c_custkey"], value=("upper", ["c_name"])), _sql("customer", "c_custkey", value="upper(c_name)")),
    "str_lower": (_columns("part", ["p_partkey"], value=("lower", ["p_type"])), _sql("part", "p_partkey", value="lower(p_type)")),
    "str_length": (_columns("documents", ["doc_id"], value=("length", ["text"])), _sql("documents", "doc_id", value="length(text)")),
    "str_concat": (_columns("part", ["p_partkey"], value=("concat", ["p_brand", "' / '", "p_type"])), _sql("part", "p_partkey", value="p_brand || ' / ' || p_type")),
    "str_contains_ignore_case": (_columns("part", ["p_partkey"], value=("contains_ignore_case", ["p_name", "'A'"])), _sql("part", "p_partkey", value="contains(lower(p_name), lower('A'))")),
    "math_trig": (
        _math("supplier", "s_suppkey", a_sin=("sin", [_S]), a_cos=("cos", [_S]), a_tan=("tan", [_S]), a_asin=("asin", [_S]), a_acos=("acos", [_S]), a_atan=("atan", [_S]), a_atan2=("atan2", [_S, "2.0"])),
        _sql("supplier", "s_suppkey", a_sin=_finite(f"sin{_S}"), a_cos=_finite(f"cos{_S}"), a_tan=_finite(f"tan{_S}"), a_asin=f"case when abs{_S} <= 1 then round(asin{_S}, 9) end", a_acos=f"case when abs{_S} <= 1 then round(acos{_S}, 9) end", a_atan=_finite(f"atan{_S}"), a_atan2=_finite(f"atan2({_S}, 2.0)")),
    ),
    "math_hyper": (
        _math("supplier", "s_suppkey", a_sinh=("sinh", [_S]), a_cosh=("cosh", [_S]), a_tanh=("tanh", [_S]), a_asinh=("asinh", [_S]), a_acosh=("acosh", [f"abs{_S} + 1"]), a_atanh=("atanh", [f"{_S} * 0.9"])),
        _sql("supplier", "s_suppkey", a_sinh=_finite(f"sinh{_S}"), a_cosh=_finite(f"cosh{_S}"), a_tanh=_finite(f"tanh{_S}"), a_asinh=_finite(f"asinh{_S}"), a_acosh=_finite(f"acosh(abs{_S} + 1)"), a_atanh=_finite(f"atanh({_S} * 0.9)")),
    ),
    "math_log": (
        _math("supplier", "s_suppkey", a_ln=("ln", ["s_acctbal"]), a_log10=("log10", ["s_acctbal"]), a_log2=("log2", ["s_acctbal"]), a_log=("log", ["s_acctbal"]), a_logb=("log", ["3.0D", "s_acctbal"]), a_exp=("exp", [_S])),
        _sql("supplier", "s_suppkey", **{k: f"case when s_acctbal > 0 then round({f}, 9) end" for k, f in {"a_ln": "ln(s_acctbal)", "a_log10": "log10(s_acctbal)", "a_log2": "log2(s_acctbal)", "a_log": "log10(s_acctbal)", "a_logb": "ln(s_acctbal) / ln(3.0)"}.items()}, a_exp=_finite(f"exp{_S}")),
    ),
    "math_round": (
        _math("supplier", "s_suppkey", a_ceil=("ceil", ["s_acctbal"]), a_ceiling=("ceiling", ["s_acctbal"]), a_floor=("floor", ["s_acctbal"]), a_trunc=("trunc", ["s_acctbal"])),
        _sql("supplier", "s_suppkey", a_ceil="ceil(s_acctbal)", a_ceiling="ceil(s_acctbal)", a_floor="floor(s_acctbal)", a_trunc="trunc(s_acctbal)"),
    ),
    "math_mod": (_math("supplier", "s_suppkey", value=("mod", ["s_acctbal", "7.0D"]), none=("mod", ["s_acctbal", "0.0D"])), _sql("supplier", "s_suppkey", value="round(s_acctbal % 7.0, 9)", none="cast(null as double)")),
    "math_pow": (_math("lineitem", "l_orderkey", value=("pow", [_Q, "2.5D"]), again=("power", [_Q, "2.5D"]), root=("sqrt", [_Q])), _sql("lineitem", "l_orderkey", value=f"round(pow({_Q}, 2.5), 9)", again=f"round(pow({_Q}, 2.5), 9)", root=f"round(sqrt({_Q}), 9)")),
    "math_sqrt_negative": (_math("supplier", "s_suppkey", value=("sqrt", ["s_acctbal"])), _sql("supplier", "s_suppkey", value="case when s_acctbal >= 0 then round(sqrt(s_acctbal), 9) end")),
    "math_angle": (_math("supplier", "s_suppkey", deg=("degrees", [_S]), rad=("radians", ["s_acctbal"]), p=("pi", [])), _sql("supplier", "s_suppkey", deg=_finite(f"degrees({_S})"), rad=_finite("radians(s_acctbal)"), p="round(pi(), 9)")),
    "dt_date": (_time("orders", "o_orderkey", value=("date", [_TEXT])), _sql("orders", "o_orderkey", value=_D)),
    "dt_time": (_time("events", "event_id", value=("time", [_EVENT])), _sql("events", "event_id", value="strftime(ts, '%H:%M:%S')")),
    "dt_time_subsec": (_time("events", "event_id", value=("time", [_EVENT], {"modifiers": ["subsec"]})), _sql("events", "event_id", value="strftime(ts, '%H:%M:%S.%g')")),
    "dt_datetime": (_time("orders", "o_orderkey", value=("datetime", [_TEXT])), _sql("orders", "o_orderkey", value=_TS)),
    "dt_julianday": (_time("orders", "o_orderkey", value=("julianday", [_DAY], {}, 6)), _sql("orders", "o_orderkey", value="round(julian(cast(o_orderdate as date)) - 0.5, 6)")),
    "dt_from_julianday": (_time("orders", "o_orderkey", value=("datetime", ["2440587.5D + o_orderkey"])), _sql("orders", "o_orderkey", value="strftime(timestamp '1970-01-01' + to_days(cast(o_orderkey as integer)), '%Y-%m-%d %H:%M:%S')")),
    "dt_unixepoch": (_time("orders", "o_orderkey", value=("unixepoch", [_TEXT])), _sql("orders", "o_orderkey", value="floor(epoch(date_trunc('second', o_orderdate)))")),
    "dt_from_unixepoch": (_time("orders", "o_orderkey", value=("datetime", ["o_orderkey * 3600"], {"modifiers": ["unixepoch"]})), _sql("orders", "o_orderkey", value="strftime(timestamp '1970-01-01' + to_hours(o_orderkey), '%Y-%m-%d %H:%M:%S')")),
    "dt_start_of": (
        _time("orders", "o_orderkey", day=("datetime", [_TEXT], {"modifiers": ["start of day"]}), month=("date", [_TEXT], {"modifiers": ["start of month"]}), year=("date", [_TEXT], {"modifiers": ["start of year"]})),
        _sql("orders", "o_orderkey", day="strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S')", month="strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')", year="strftime(date_trunc('year', o_orderdate), '%Y-%m-%d')"),
    ),
    "dt_shift_days": (_time("orders", "o_orderkey", value=("datetime", [_TEXT], {"modifiers": ["+45 days", "-3 hours", "+00:30"]})), _sql("orders", "o_orderkey", value="strftime(date_trunc('second', o_orderdate) + interval 45 day - interval 3 hour + interval 30 minute, '%Y-%m-%d %H:%M:%S')")),
    "dt_shift_months": (_time("orders", "o_orderkey", value=("date", [_TEXT], {"modifiers": ["+1 month"]}), years=("date", [_TEXT], {"modifiers": ["-1 year"]})), _sql("orders", "o_orderkey", value="strftime(o_orderdate + interval 1 month, '%Y-%m-%d')", years="strftime(o_orderdate - interval 1 year, '%Y-%m-%d')")),
    "dt_weekday": (_time("orders", "o_orderkey", value=("date", [_TEXT], {"modifiers": ["weekday 2"]})), _sql("orders", "o_orderkey", value="strftime(o_orderdate + to_days(cast((2 - dayofweek(o_orderdate) + 7) % 7 as integer)), '%Y-%m-%d')")),
    "dt_strftime": (_time("orders", "o_orderkey", value=("strftime", [_TEXT], {"form": "%Y/%m/%d %H:%M:%S %j %w %u %%"})), _sql("orders", "o_orderkey", value="strftime(o_orderdate, '%Y/%m/%d %H:%M:%S %j %w %u %%')")),
    "dt_strftime_clock": (_time("orders", "o_orderkey", value=("strftime", [_TEXT], {"form": "%I %p %F %T %R"})), _sql("orders", "o_orderkey", value="strftime(o_orderdate, '%I %p %Y-%m-%d %H:%M:%S %H:%M')")),
    "dt_strftime_codes": (
        _time("events", "event_id", value=("strftime", [_EVENT], {"form": "%e|%f|%g|%G|%k|%l|%P|%s|%U|%V|%W|%M"}), none=("strftime", [_EVENT], {"form": "%Y %Q"}), cut=("strftime", [_EVENT], {"form": "%Y %"})),
        _sql(
            "events",
            "event_id",
            value="strftime(ts, '%-d|%S.%g|%y|%Y|%-H|%-I|') || lower(strftime(ts, '%p')) || '|' || cast(epoch_us(ts) // 1000000 as varchar) || printf('|%02d|%02d|%02d|', (dayofyear(ts) + 5) // 7, (dayofyear(ts) + 2) // 7, (dayofyear(ts) - 1) // 7) || strftime(ts, '%M')",
            none="cast(null as varchar)",
            cut="cast(null as varchar)",
        ),
    ),
    "dt_strftime_julian": (
        lambda spark, d: _time("events", "event_id", value=("strftime", [_EVENT], {"form": "%J"}))(spark, d).withColumn("value", F.round(F.col("value").cast("double"), 6)),
        _sql("events", "event_id", value="round(epoch_us(ts) // 1000 / 86400000.0 + 2440587.5, 6)"),
    ),
    "dt_timediff_clock": (
        _time("events", "event_id", value=("timediff", [_EVENT, "'2024-01-15 13:14:15.678'"])),
        "select event_id, case when ms < 0 then '-' else '+' end || printf('%04d-%02d-%02d %02d:%02d:%02d.%03d', abs(ms) // 86400000 // 365, abs(ms) // 86400000 % 365 // 30, abs(ms) // 86400000 % 365 % 30, abs(ms) // 3600000 % 24, abs(ms) // 60000 % 60, abs(ms) // 1000 % 60, abs(ms) % 1000) as value "
        "from (select event_id, epoch_us(ts) // 1000 - epoch_us(timestamp '2024-01-15 13:14:15.678') // 1000 as ms from events)",
    ),
    "dt_timediff": (
        _time("orders", "o_orderkey", value=("timediff", [_DAY, "'1995-01-01'"])),
        "select o_orderkey, case when s < 0 then '-' else '+' end || printf('%04d-%02d-%02d 00:00:00.000', n // 365, n % 365 // 30, n % 30) as value from (select o_orderkey, datediff('day', date '1995-01-01', cast(o_orderdate as date)) as s, abs(s) as n from orders)",
    ),
}


def queries() -> dict:
    return {k: v[0] for k, v in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _ENTRIES.items()}
