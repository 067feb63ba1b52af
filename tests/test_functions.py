import math

import pytest
from pyspark.sql import functions as F

from quarry import registry
from quarry.errors import InvalidOperation, TypeMismatch


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(1,)], "one int")


def call(row, name, *args, kinds=None, **options):
    columns = [F.lit(a) if not isinstance(a, tuple) else F.lit(a[0]).cast(a[1]) for a in args]
    return row.select(registry().scalar(row, name, *columns, **options).alias("v")).first()["v"]


def test_text(row):
    assert call(row, "upper", "hello") == "HELLO" and call(row, "lower", "WORLD") == "world"
    assert call(row, "length", "héllo") == 5 and call(row, "length", bytearray(b"abc")) == 3 and call(row, "length", "") == 0
    assert call(row, "concat") == "" and call(row, "concat", "a", "b") == "ab"
    assert call(row, "contains_ignore_case", "Hello", "ELL")
    for name, args in (("length", (123,)), ("concat", ("ok", 42)), ("upper", (1,))):
        with pytest.raises(TypeMismatch):
            call(row, name, *args)
    with pytest.raises(Exception, match="NULL"):
        call(row, "upper", (None, "string"), strict=True)
    assert call(row, "upper", (None, "string")) is None


def test_math(row):
    assert [call(row, "mod", a, b) for a, b in ((5, 2), (-5, 2), (5, -2), (5, 0))] == [1.0, -1.0, 1.0, None]
    assert call(row, "log", 2, 8) == pytest.approx(3.0) and call(row, "log", 100.0) == pytest.approx(2.0)
    assert [call(row, "log", b, 10) for b in (1, 0, -1)] == [None] * 3
    assert call(row, "sin", "hello") is None and call(row, "sin", "0") == 0.0 and call(row, "sqrt", " 1 ") is None
    assert call(row, "sqrt", -1) is None and call(row, "exp", 1000) is None and call(row, "atanh", 1) is None
    assert call(row, "asinh", -1e10) == pytest.approx(math.asinh(-1e10)) and call(row, "asinh", 1e300) == pytest.approx(math.asinh(1e300))
    assert call(row, "asinh", 1e-9) == pytest.approx(1e-9, rel=1e-12)
    assert [call(row, f, -1.5) for f in ("ceil", "floor", "trunc")] == [-1.0, -2.0, -1.0] and call(row, "ceil", 1e300) == 1e300
    assert call(row, "pi") == math.pi and call(row, "degrees", math.pi) == 180.0 and call(row, "power", 2, 10) == 1024.0
    assert call(row, "pow", 2) is None and call(row, "sin", True) is None
    with pytest.raises(InvalidOperation):
        call(row, "sin")


@pytest.mark.parametrize(
    ("name", "value", "modifiers", "want"),
    [
        ("date", "2024-03-05", [], "2024-03-05"),
        ("date", "2024-02-15", ["start of month"], "2024-02-01"),
        ("date", "2024-01-01", ["+1 day"], "2024-01-02"),
        ("date", "2024-01-31", ["+1 month"], "2024-02-29"),
        ("date", "2024-02-29", ["-1 year"], "2023-02-28"),
        ("date", "2024-03-05", ["weekday 2"], "2024-03-05"),
        ("date", "2024-03-05", ["weekday 0"], "2024-03-10"),
        ("date", "2024-03-05", ["+0001-02-03"], "2025-05-08"),
        ("datetime", "2024-03-05T12:34:56", [], "2024-03-05 12:34:56"),
        ("datetime", "2024-03-05 12:34:56.789", ["subsec"], "2024-03-05 12:34:56.789"),
        ("datetime", "2024-03-05 12:34", ["-01:35"], "2024-03-05 10:59:00"),
        ("datetime", "2024-12-31 23:59:59.7", ["+0 seconds"], "2025-01-01 00:00:00"),
        ("time", "12:34:56", [], "12:34:56"),
        ("time", "12:34:56.789", ["subsec"], "12:34:56.789"),
        ("datetime", "now", [], "2000-01-01 12:00:00"),
        ("datetime", 2451545.0, [], "2000-01-01 12:00:00"),
        ("datetime", 86400, ["unixepoch"], "1970-01-02 00:00:00"),
        ("julianday", "2000-01-01", [], 2451544.5),
        ("unixepoch", "1970-01-01T00:00:01.5", [], 1.0),
        ("unixepoch", "1970-01-01T00:00:01.5", ["subsec"], 1.5),
        ("unixepoch", "1970-01-01", [], 0.0),
        ("date", "not-a-date", [], None),
        ("date", "2024-13-05", [], None),
    ],
)
def test_times(row, name, value, modifiers, want):
    assert call(row, name, value, modifiers=modifiers) == want


def test_years_of_other_than_four_digits(row):
    # 2440587.5 is 1970-01-01; a count of seconds in decimal(18,6) ends after 11,574,074 days.
    for days, want in ((2932896, "9999-12-31"), (2932897, "10000-01-01"), (8999999, "26611-03-01"), (11574075, "33658-09-28"), (-719528, "0000-01-01"), (-719529, "-001-12-31"), (-1000000, "-768-02-04")):
        assert call(row, "date", 2440587.5 + days) == call(row, "strftime", 2440587.5 + days, form="%F") == want
        assert call(row, "datetime", 2440587.5 + days) == f"{want} 00:00:00" and call(row, "strftime", 2440587.5 + days, form="%Y") == want[:-6]
    assert call(row, "datetime", "9999-12-31 23:59:59.7", modifiers=["+1 second", "subsec"]) == "10000-01-01 00:00:01.000"
    assert call(row, "strftime", "not-a-date", form="%Y") is None and call(row, "strftime", "not-a-date", form="%g") is None


def test_time_errors(row):
    with pytest.raises(InvalidOperation):
        call(row, "date", "2024-01-01", modifiers=["next week"])
    with pytest.raises(InvalidOperation):
        call(row, "date", "2024-01-01", modifiers=["weekday 7"])
    with pytest.raises(Exception, match="no time value"):
        call(row, "date", "not-a-date", strict=True)


def test_strftime(row):
    form = "%%|%d|%e|%f|%F|%G|%g|%H|%I|%j|%J|%k|%l|%m|%M|%p|%P|%R|%s|%S|%T|%U|%W|%V|%u|%w|%Y"
    got = call(row, "strftime", "2024-03-05 14:07:09.25", form=form).split("|")
    assert got == ["%", "05", "5", "09.250", "2024-03-05", "2024", "24", "14", "02", "065", got[10], "14", "2", "03", "07", "PM", "pm", "14:07", "1709647629", "09", "14:07:09", "10", "09", "09", "2", "2", "2024"]
    assert float(got[10]) == pytest.approx(2460375.0882992)
    assert call(row, "strftime", "2024-03-05", form="%Q") is None and call(row, "strftime", "2024-03-05", form="%Y%") is None


def test_timediff(row):
    assert call(row, "timediff", "2024-03-05", "2024-03-05") == "+0000-00-00 00:00:00.000"
    assert call(row, "timediff", "2024-03-05", "2024-03-04") == "+0000-00-01 00:00:00.000"
    assert call(row, "timediff", "2024-03-04", "2024-03-05 01:02:03.5") == "-0000-00-01 01:02:03.500"
