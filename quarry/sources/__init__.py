"""Sources and sinks: the table store, and Parquet tables of a folder."""

from pyspark.sql import DataFrame, SparkSession

from .contracts import CatalogStore, Index, RowStore
from .index import RowIndex
from .store import MemoryCatalog, TableStore
from .viewer import Viewer

__all__ = ["CatalogStore", "Index", "MemoryCatalog", "RowIndex", "RowStore", "TableStore", "Viewer", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, read lazily: filters and columns reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
