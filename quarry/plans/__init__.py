"""Registered queries of the engine's own operators, with their SQL equivalents."""

from __future__ import annotations

from . import relational, scalars, storage

_MODULES = (relational, scalars, storage)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.oracle_sql().items()}
