"""Errors of the engine, each with a kind."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors; ``kind`` names the family."""

    kind = "other"


class NotFoundError(EngineError):
    kind = "not_found"


class TableNotFound(EngineError):
    kind = "invalid_operation"


class ColumnNotFound(EngineError):
    kind = "invalid_operation"


class IndexOutOfBounds(EngineError):
    kind = "out_of_bounds"


class TypeMismatch(EngineError):
    kind = "type_mismatch"


class InvalidOperation(EngineError):
    kind = "invalid_operation"


class Unsupported(EngineError):
    kind = "unsupported"


class ConstraintViolation(EngineError):
    kind = "constraint_violation"


class NotNullViolation(ConstraintViolation):
    pass


class CheckViolation(ConstraintViolation):
    pass


class UniqueViolation(ConstraintViolation):
    pass


class ForeignKeyViolation(ConstraintViolation):
    pass


class CorruptData(EngineError):
    kind = "corrupt_data"


class Locked(EngineError):
    kind = "locked"


def from_spark(error: Exception) -> EngineError:
    """The engine's error for one that Spark raised at analysis or at run time."""
    text = str(error)
    families = (
        (("UNRESOLVED_COLUMN",), ColumnNotFound),
        (("TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND"), TableNotFound),
        (("DATATYPE_MISMATCH.VALUE_OUT_OF_RANGE", "ARITHMETIC_OVERFLOW", "DIVIDE_BY_ZERO", "VALUE_OUT_OF_RANGE"), InvalidOperation),
        (("DATATYPE_MISMATCH", "CAST_INVALID_INPUT", "USER_RAISED_EXCEPTION"), TypeMismatch),
    )
    for marks, kind in families:
        if any(m in text for m in marks):
            return kind(text)
    return EngineError(text)
