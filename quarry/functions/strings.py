"""Text scalars. Types are checked when the plan is built; a null value is an error when strict, else null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidOperation, TypeMismatch
from ..schema import MAX_TEXT_BYTES


def _need(columns, kinds, name, types) -> None:
    if not columns:
        raise InvalidOperation(f"{name} needs an argument")
    if not isinstance(kinds[0], types):
        raise TypeMismatch(f"{name} of {kinds[0].simpleString()}")


def present(x: Column, name: str, strict: bool) -> Column:
    return F.coalesce(x, F.raise_error(f"{name} of NULL")) if strict else x


def upper(columns, kinds, strict=False):
    _need(columns, kinds, "upper", T.StringType)
    return F.upper(present(columns[0], "upper", strict))


def lower(columns, kinds, strict=False):
    _need(columns, kinds, "lower", T.StringType)
    return F.lower(present(columns[0], "lower", strict))


def length(columns, kinds, strict=False):
    """Code points of text, bytes of blobs."""
    _need(columns, kinds, "length", (T.StringType, T.BinaryType))
    return F.length(present(columns[0], "length", strict)).cast("long")


def concat(columns, kinds, strict=False):
    if not columns:
        return F.lit("")
    for k in kinds:
        if not isinstance(k, T.StringType):
            raise TypeMismatch(f"concat of {k.simpleString()}")
    out = F.concat(*(present(c, "concat", strict) for c in columns))
    return F.when(F.octet_length(out) <= MAX_TEXT_BYTES, out).when(out.isNotNull(), F.raise_error("concat is too long")) if strict else out


def contains_ignore_case(columns, kinds, strict=False):
    return F.lower(columns[0]).contains(F.lower(columns[1]))


SCALARS = {"upper": upper, "lower": lower, "length": length, "concat": concat, "contains_ignore_case": contains_ignore_case}
