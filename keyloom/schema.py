"""Logical types, key columns, row columns and index definitions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The thirteen logical types and the Spark types that carry them.
SPARK_TYPES = {
    "BOOLEAN": "boolean",
    "BYTE": "tinyint",
    "SHORT": "smallint",
    "INT": "int",
    "LONG": "bigint",
    "FLOAT": "float",
    "DOUBLE": "double",
    "STRING": "string",
    "LOCAL_DATE": "date",
    "LOCAL_DATE_TIME": "timestamp_ntz",
    "INSTANT": "timestamp",
    "UUID": "string",
    "BYTES": "binary",
}
TOO_LONG = "a key has more values than the index has key columns"
SECONDS = ("LOCAL_DATE_TIME", "INSTANT")


def _check_type(kind: str) -> None:
    if kind not in SPARK_TYPES:
        raise ValueError(f"unknown type {kind}")


@dataclass(frozen=True)
class KeyColumn:
    """A column of a key: nullable, ascending or descending, a STRING perhaps under a collation."""

    name: str
    type: str
    descending: bool = False
    collation: str | None = None

    def __post_init__(self) -> None:
        _check_type(self.type)
        if self.collation is not None and self.type != "STRING":
            raise ValueError(f"{self.name}: only STRING has collations")


@dataclass(frozen=True)
class RowColumn:
    name: str
    type: str
    nullable: bool = True

    def __post_init__(self) -> None:
        _check_type(self.type)


@dataclass(frozen=True)
class IndexSpec:
    """What an index is: its key columns in order, its row columns, and whether keys may leave out trailing columns."""

    name: str
    key: tuple[KeyColumn, ...]
    row: tuple[RowColumn, ...] = ()
    short_keys: bool = False

    def __post_init__(self) -> None:
        names = [c.name for c in (*self.key, *self.row)]
        if not self.key:
            raise ValueError("an index needs a key")
        if len(set(names)) < len(names):
            raise ValueError("column names must differ")
        if {"_seq", "_arity"} & set(names) or any(n.startswith("__") for n in names):
            raise ValueError("_seq, _arity and names that begin with __ are the index's own")

    @property
    def key_names(self) -> list[str]:
        return [c.name for c in self.key]

    @property
    def row_names(self) -> list[str]:
        return [c.name for c in self.row]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> IndexSpec:
        d = json.loads(text)
        return IndexSpec(d["name"], tuple(KeyColumn(**c) for c in d["key"]), tuple(RowColumn(**c) for c in d["row"]), d["short_keys"])


def index_spec(name: str, key: Sequence[tuple | KeyColumn], row: Sequence[tuple | RowColumn] = (), short_keys: bool = False) -> IndexSpec:
    """An IndexSpec from tuples (name, type[, descending[, collation]]) and (name, type[, nullable])."""
    return IndexSpec(name, tuple(c if isinstance(c, KeyColumn) else KeyColumn(*c) for c in key), tuple(c if isinstance(c, RowColumn) else RowColumn(*c) for c in row), short_keys)


def coerced(column: Column, kind: str) -> Column:
    """column as its logical type: times lose what is below the second, UUIDs are lower case."""
    value = column.cast(SPARK_TYPES[kind])
    if kind in SECONDS:
        return F.date_trunc("second", value).cast(SPARK_TYPES[kind])
    if kind == "UUID":
        return F.lower(value)
    return value


def checked(df: DataFrame, columns: Sequence[RowColumn]) -> list[Column]:
    """The row columns of df; a NULL where none may be fails the query."""
    out = []
    for c in columns:
        value = coerced(F.col(c.name), c.type)
        if not c.nullable:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"{c.name} is not nullable, and a row has NULL there"))).otherwise(value)
        out.append(value.alias(c.name))
    return out
