"""What the engine asks of stores, for those who bring their own (X02, X19). ``SnapshotStore`` has all of it."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class TableStore(Protocol):
    """Tables by name."""

    def exists(self, name: str) -> bool: ...
    def load(self, name: str, *, source: str | None = None, order: Iterable[str] = ()) -> DataFrame: ...


@runtime_checkable
class CommittingStore(TableStore, Protocol):
    """Tables that are published together or not at all."""

    def version(self) -> int: ...
    def commit(self, tables: dict[str, DataFrame]) -> int: ...


class GraphSource(Protocol):
    """What pages of graphs are drawn from: nodes and edges of one document or of all."""

    def graph(self, source: str | None = None) -> tuple[DataFrame, DataFrame]: ...


class StoredGraphs:
    """The graphs of a store, for drawing."""

    def __init__(self, store: TableStore) -> None:
        self.store = store

    def graph(self, source: str | None = None) -> tuple[DataFrame, DataFrame]:
        if source is None:
            return self.store.load("kb_nodes"), self.store.load("kb_edges")
        return self.store.load("graph_nodes", source=source), self.store.load("graph_edges", source=source)
