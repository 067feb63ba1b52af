"""Mathematical scalars: every result is a finite double or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidOperation

_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def to_double(x: Column, kind: T.DataType) -> Column:
    """Numbers as doubles, numeric text parsed, all else null."""
    if isinstance(kind, (*_INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)):
        return x.cast("double")
    if isinstance(kind, T.StringType):
        return F.when(x.rlike(_NUMBER), x.try_cast("double"))
    return F.lit(None).cast("double")


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def _whole(f):
    """A rounding function that leaves doubles which hold no fraction alone."""
    return lambda x: F.when(F.abs(x) < F.lit(float(1 << 53)), f(x).cast("double")).otherwise(x)


def _asinh(x: Column) -> Column:
    small = F.signum(x) * F.log1p(F.abs(x) + x * x / (1 + F.sqrt(x * x + 1)))
    return F.when(F.abs(x) < F.lit(1e150), small).otherwise(F.signum(x) * (F.ln(F.abs(x)) + F.ln(F.lit(2.0))))


_ceil, _floor = _whole(F.ceil), _whole(F.floor)

UNARY = {
    "acos": F.acos, "acosh": F.acosh, "asin": F.asin, "asinh": _asinh, "atan": F.atan, "atanh": F.atanh, "ceil": _ceil, "ceiling": _ceil,
    "cos": F.cos, "cosh": F.cosh, "degrees": F.degrees, "exp": F.exp, "floor": _floor, "ln": F.ln, "log10": F.log10, "log2": F.log2,
    "radians": F.radians, "sin": F.sin, "sinh": F.sinh, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh,
    "trunc": lambda x: F.when(x < 0, _ceil(x)).otherwise(_floor(x)),
}


def _power(x: Column, y: Column) -> Column:
    return F.pow(x, y)


BINARY = {"atan2": F.atan2, "mod": F.try_mod, "pow": _power, "power": _power}


def _unary(name):
    def build(columns, kinds):
        if not columns:
            raise InvalidOperation(f"{name} needs an argument")
        return finite(UNARY[name](to_double(columns[0], kinds[0])))

    return build


def _binary(name):
    def build(columns, kinds):
        if len(columns) != 2:
            return F.lit(None).cast("double")
        return finite(BINARY[name](*(to_double(c, k) for c, k in zip(columns, kinds))))

    return build


def _log(columns, kinds):
    """One argument: base 10. Two: base, then number; a base of 1 or less than 0, or a number not above 0, gives null."""
    values = [to_double(c, k) for c, k in zip(columns, kinds)]
    if len(values) == 1:
        return finite(F.log10(values[0]))
    if len(values) != 2:
        return F.lit(None).cast("double")
    base, x = values
    return finite(F.when((base > 0) & (base != 1) & (x > 0), F.ln(x) / F.ln(base)))


SCALARS = {n: _unary(n) for n in UNARY} | {n: _binary(n) for n in BINARY} | {"log": _log, "pi": lambda columns, kinds: F.pi()}
