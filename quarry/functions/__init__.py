"""Scalar, aggregate and window functions as Column expressions."""

from .registry import FunctionRegistry, registry

__all__ = ["FunctionRegistry", "registry"]
