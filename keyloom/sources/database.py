"""A database: a folder of named indexes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from keyloom.operators.index import OrderedIndex
from keyloom.schema import IndexSpec
from keyloom.sources.snapshots import COMMITS, Folder, IndexStoreError, commit_index, create_index, last_commit, open_index


@dataclass(frozen=True)
class Database:
    spark: SparkSession
    path: str

    def _at(self, name: str) -> str:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"{name!r} is no name for an index")
        return f"{self.path}/{name}"

    def create_index(self, spec: IndexSpec, files: int = 1) -> OrderedIndex:
        """A new, empty index under its spec's name."""
        return create_index(self.spark, self._at(spec.name), spec, files)

    def open_index(self, name: str) -> OrderedIndex:
        """An index as last committed."""
        if name not in self.names():
            raise IndexStoreError(f"there is no index {name}")
        return open_index(self.spark, self._at(name))

    def commit(self, index: OrderedIndex, files: int | None = None) -> OrderedIndex:
        """Make index the state of the index of its name."""
        return commit_index(index, self._at(index.spec.name), files)

    def names(self) -> list[str]:
        return sorted(n for n in Folder(self.spark, self.path).names() if Folder(self.spark, f"{self.path}/{n}").names(COMMITS))

    def stats(self, name: str) -> dict[str, int]:
        """Of an index as last committed: commit (its number), files, entries and bytes."""
        commit = last_commit(self.spark, self._at(name))
        if commit is None:
            raise IndexStoreError(f"there is no index {name}")
        return {"commit": commit.number, "files": commit.files, "entries": commit.entries, "bytes": commit.bytes}

    def drop_index(self, name: str) -> None:
        if name in self.names():
            Folder(self.spark, self.path).delete(name)
