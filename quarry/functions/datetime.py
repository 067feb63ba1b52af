"""Date and time scalars over text, Julian days and timestamps, as Column expressions without time zones.

A time value is an integer or double (a Julian day, or Unix seconds if the first modifier is
``unixepoch``), text (``now``, a Julian day, ``YYYY-MM-DD[( |T)HH:MM[:SS[.fff]]]`` or ``HH:MM[:SS[.fff]]``), or a
Spark date or timestamp. Modifiers are literals and apply from left to right. ``now`` is a constant, 2000-01-01 12:00.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidOperation, TypeMismatch

_DATE = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[ T]([0-9]{2}):([0-9]{2})(?::([0-9]{2})([.][0-9]+)?.*)?)?$"
_TIME = r"^([0-9]{2}):([0-9]{2})(?::([0-9]{2})([.][0-9]+)?.*)?$"
_JULIAN = r"^[+-]?[0-9]+([.][0-9]*)?$"
_EPOCH_JULIAN = 2440587.5
_NOOP = frozenset("unixepoch julianday auto utc localtime ceiling floor subsec subsecond".split())
_UNITS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}
_SHIFT = re.compile(r"^([+-]?\d+(?:\.\d+)?) (day|hour|minute|second|month|year)s?$")
_CLOCK = re.compile(r"^([+-])(\d{2}):(\d{2})(?::(\d{2}))?$")
_CALENDAR = re.compile(r"^([+-])(\d{4})-(\d{2})-(\d{2})$")


def _ntz(x: Column) -> Column:
    return x.cast("timestamp_ntz")


def seconds(ts: Column) -> Column:
    """Exact seconds since 1970, as a decimal, from the fields alone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("decimal(20,6)")
    return days * 86400 + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("decimal(20,6)") + F.extract(F.lit("SECOND"), ts)


def from_seconds(s: Column) -> Column:
    """The time that many (decimal or double) seconds after 1970."""
    # Named once, as modifiers nest it; make_dt_interval's decimal(18,6) would end in the year 33658.
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.expr("interval '1' second") * s.cast("decimal(20,6)")


def _rounded(ts: Column) -> Column:
    return from_seconds(F.floor(seconds(ts) + F.lit(0.5).cast("decimal(4,1)")))


def _part(x: Column, pattern: str, k: int) -> Column:
    found = F.regexp_extract(x, pattern, k)
    return F.when(found == "", "0").otherwise(found)


def _text_time(x: Column) -> Column:
    date = [_part(x, _DATE, k).cast("int") for k in range(1, 6)]
    clock = [_part(x, _TIME, k).cast("int") for k in (1, 2)]
    second = lambda p, a, b: F.concat(_part(x, p, a), F.regexp_extract(x, p, b)).cast("decimal(8,6)")
    return (
        F.when(x == "now", F.lit("2000-01-01 12:00:00").cast("timestamp_ntz"))
        .when(x.rlike(_JULIAN), from_seconds(F.round((x.try_cast("double") - _EPOCH_JULIAN) * 86400)))
        .when(x.rlike(_DATE), F.try_make_timestamp_ntz(*date, second(_DATE, 6, 7)))
        .when(x.rlike(_TIME), F.try_make_timestamp_ntz(F.lit(2000), F.lit(1), F.lit(1), *clock, second(_TIME, 3, 4)))
    )


def parsed(x: Column, kind: T.DataType, modifiers: list[str], strict: bool = False) -> Column:
    """A time value as a timestamp without zone; what cannot be read is null, or an error when strict."""
    if isinstance(kind, T.StringType):
        out = _text_time(x)
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
        number = x.cast("double")
        out = from_seconds(F.round(number if modifiers[:1] == ["unixepoch"] else (number - _EPOCH_JULIAN) * 86400))
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        out = _ntz(x)
    else:
        raise TypeMismatch(f"no time value: {kind.simpleString()}")
    return F.coalesce(out, _ntz(F.raise_error("no time value"))) if strict else out


def _months(ts: Column, n: int) -> Column:
    if abs(n) > 1_000_000:
        raise InvalidOperation("too many months")
    return ts + F.make_ym_interval(F.lit(0), F.lit(n))


def _by_seconds(ts: Column, n: float) -> Column:
    return _rounded(ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n).cast("decimal(18,6)")))


def modified(ts: Column, modifiers: list[str]) -> Column:
    for raw in modifiers:
        m = raw.strip().lower()
        if m in _NOOP:
            continue
        if m.startswith("start of ") and m[9:] in ("day", "month", "year"):
            ts = _ntz(F.date_trunc(m[9:], ts)) if m[9:] == "day" else _ntz(F.trunc(ts.cast("date"), m[9:]))
        elif m.startswith("weekday "):
            n = m[8:].strip()
            if not n.isdigit() or int(n) > 6:
                raise InvalidOperation(raw)
            ahead = (F.lit(int(n)) - (F.dayofweek(ts) - 1) + 7) % 7
            ts = ts + F.make_dt_interval(ahead)
        elif found := _SHIFT.match(m):
            n, unit = float(found[1]), found[2]
            if unit in ("month", "year"):
                ts = _months(ts, int(n + (0.5 if n >= 0 else -0.5)) * (12 if unit == "year" else 1))
            else:
                ts = _by_seconds(ts, n * _UNITS[unit])
        elif found := _CLOCK.match(m):
            size = int(found[2]) * 3600 + int(found[3]) * 60 + int(found[4] or 0)
            ts = _by_seconds(ts, float(-size if found[1] == "-" else size))
        elif found := _CALENDAR.match(m):
            sign = -1 if found[1] == "-" else 1
            ts = _by_seconds(_months(_months(ts, sign * 12 * int(found[2])), sign * int(found[3])), float(sign * 86400 * int(found[4])))
        else:
            raise InvalidOperation(f"unknown modifier {raw}")
    return ts


def _subsec(modifiers) -> bool:
    return any(m.strip().lower() in ("subsec", "subsecond") for m in modifiers)


def julian(ts: Column) -> Column:
    return (seconds(ts) / 86400).cast("double") + F.lit(_EPOCH_JULIAN)


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _format(ts: Column, pattern: str) -> Column:
    """Text by a pattern; a year at its start is padded to four places, a minus included (Spark has +10000 and -0768)."""
    out = F.date_format(ts, pattern)
    return F.regexp_replace(out, "^[+]|(?<=^-)0", "") if pattern.startswith("yyyy") else out


def _code(ts: Column, c: str) -> Column | None:
    plain = {"d": "dd", "e": "d", "F": "yyyy-MM-dd", "G": "yyyy", "g": "yy", "H": "HH", "I": "hh", "j": "DDD", "k": "H", "l": "h", "m": "MM", "M": "mm", "R": "HH:mm", "S": "ss", "T": "HH:mm:ss", "Y": "yyyy"}
    if c in plain:
        return _format(ts, plain[c])
    day = F.dayofyear(ts) - 1
    other = {
        "%": lambda: F.lit("%"),
        "f": lambda: F.format_string("%06.3f", F.extract(F.lit("SECOND"), ts).cast("double")),
        "p": lambda: F.when(F.hour(ts) < 12, "AM").otherwise("PM"),
        "P": lambda: F.when(F.hour(ts) < 12, "am").otherwise("pm"),
        "s": lambda: F.floor(seconds(ts)).cast("long").cast("string"),
        "J": lambda: julian(ts).cast("string"),
        "U": lambda: _two(F.floor((day + 6) / 7).cast("int")),
        "W": lambda: _two(F.floor(day / 7).cast("int")),
        "V": lambda: _two(F.floor((day + 3) / 7).cast("int")),
        "u": lambda: (F.weekday(ts) + 1).cast("string"),
        "w": lambda: (F.dayofweek(ts) - 1).cast("string"),
    }
    return other[c]() if c in other else None


def strftime_of(ts: Column, form: str) -> Column:
    """Text of a time by a literal format; an unknown code or a last lone % gives null."""
    parts, k = [], 0
    while k < len(form):
        if form[k] != "%":
            end = form.find("%", k)
            end = len(form) if end < 0 else end
            parts.append(F.lit(form[k:end]))
            k = end
            continue
        code = _code(ts, form[k + 1]) if k + 1 < len(form) else None
        if code is None:
            return F.lit(None).cast("string")
        parts.append(code)
        k += 2
    return F.concat(*parts) if parts else F.when(ts.isNotNull(), F.lit(""))


def timediff_of(a: Column, b: Column) -> Column:
    """±YYYY-MM-DD HH:MM:SS.SSS of a - b, with years of 365 and months of 30 days."""
    delta = seconds(a) - seconds(b)
    size = F.abs(delta)
    days = F.floor(size / 86400).cast("long")
    rest = size - days.cast("decimal(20,0)") * 86400
    whole = F.floor(rest).cast("long")
    sign = F.when(delta < 0, "-").otherwise("+")
    fields = ((days / 365).cast("long"), (days % 365 / 30).cast("long"), days % 30, (whole / 3600).cast("long"), (whole % 3600 / 60).cast("long"), (rest - (whole - whole % 60).cast("decimal(20,0)")).cast("double"))
    return F.concat(sign, F.format_string("%04d-%02d-%02d %02d:%02d:%06.3f", *fields))


def _literals(modifiers) -> list[str]:
    for m in modifiers:
        if not isinstance(m, str):
            raise TypeMismatch("modifiers are literal text")
    return list(modifiers)


def _scalar(form):
    def build(columns, kinds, modifiers=(), strict=False):
        mods = _literals(modifiers)
        x, kind = (columns[0], kinds[0]) if columns else (F.lit("now"), T.StringType())
        return form(modified(parsed(x, kind, mods, strict), mods), mods)

    return build


def _clock(ts, mods):
    return _format(ts, "HH:mm:ss.SSS" if _subsec(mods) else "HH:mm:ss")


def _datetime(ts, mods):
    return _format(ts, "yyyy-MM-dd HH:mm:ss.SSS" if _subsec(mods) else "yyyy-MM-dd HH:mm:ss")


def _unixepoch(ts, mods):
    return seconds(ts).cast("double") if _subsec(mods) else F.floor(seconds(ts)).cast("double")


def strftime(columns, kinds, modifiers=(), strict=False, form: str = ""):
    mods = _literals(modifiers)
    x, kind = (columns[0], kinds[0]) if columns else (F.lit("now"), T.StringType())
    return strftime_of(modified(parsed(x, kind, mods, strict), mods), form)


def timediff(columns, kinds, modifiers=(), strict=False):
    if len(columns) != 2:
        raise InvalidOperation("timediff needs two arguments")
    return timediff_of(*(parsed(c, k, [], strict) for c, k in zip(columns, kinds)))


SCALARS = {
    "date": _scalar(lambda ts, mods: _format(ts, "yyyy-MM-dd")),
    "time": _scalar(_clock),
    "datetime": _scalar(_datetime),
    "julianday": _scalar(lambda ts, mods: julian(ts)),
    "unixepoch": _scalar(_unixepoch),
    "strftime": strftime,
    "timediff": timediff,
}
