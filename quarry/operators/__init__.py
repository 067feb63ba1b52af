"""Relational operators."""

from .query import Query, query, query_project

__all__ = ["Query", "query", "query_project"]
