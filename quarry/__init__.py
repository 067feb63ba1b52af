"""A PySpark-native analytics engine: fluent queries, a function registry and a table store."""

from .functions import FunctionRegistry, registry
from .operators import Query, query, query_project
from .schema import CheckConstraint, ColumnDef, ForeignKey, TableSchema
from .sources import MemoryCatalog, RowIndex, TableStore, Viewer, table

__all__ = ["CheckConstraint", "ColumnDef", "ForeignKey", "FunctionRegistry", "MemoryCatalog", "Query", "RowIndex", "TableSchema", "TableStore", "Viewer", "query", "query_project", "registry", "table"]
