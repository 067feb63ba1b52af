"""What every catalog, table store and index offers, whatever holds its data."""

from __future__ import annotations

from abc import ABC, abstractmethod

from ..schema import TableSchema


class CatalogStore(ABC):
    """Names and schemas of tables."""

    @abstractmethod
    def create_table(self, schema: TableSchema) -> None: ...

    @abstractmethod
    def drop_table(self, name: str) -> None: ...

    @abstractmethod
    def rename_table(self, old: str, new: str) -> None: ...

    @abstractmethod
    def schema(self, name: str) -> TableSchema: ...

    @abstractmethod
    def catalog(self) -> dict[str, TableSchema]: ...


class RowStore(ABC):
    """Rows of named tables."""

    @abstractmethod
    def scan(self, name: str): ...

    @abstractmethod
    def insert(self, name: str, rows) -> None: ...

    @abstractmethod
    def set_cell(self, name: str, row: int, column: int | str, value) -> None: ...

    @abstractmethod
    def replace_rows(self, name: str, rows) -> None: ...


class Index(ABC):
    """Keys with the numbers of their rows; null keys are not held."""

    @abstractmethod
    def insert(self, key, row: int) -> None: ...

    @abstractmethod
    def remove(self, key, row: int) -> None: ...

    @abstractmethod
    def lookup(self, key) -> list[int] | None: ...
