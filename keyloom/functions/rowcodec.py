"""Rows as byte strings: a bitmap of NULLs (first column in the highest bit), then the other values one after another."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.keycodec import WIDTHS, epoch_seconds, struct_array
from keyloom.functions.primitives import fixed_hex, float_hex, read_varint, varint_hex
from keyloom.schema import SPARK_TYPES, RowColumn

FIXED = {"BOOLEAN": 1, **WIDTHS, "FLOAT": 4, "DOUBLE": 8, "LOCAL_DATE": 8, "LOCAL_DATE_TIME": 8, "INSTANT": 8, "UUID": 16}


def _value_hex(value: Column, kind: str) -> Column:
    if kind == "BOOLEAN":
        return F.when(value, "01").otherwise("00")
    if kind in WIDTHS:
        return fixed_hex(value, WIDTHS[kind])
    if kind in ("FLOAT", "DOUBLE"):
        return float_hex(value, kind == "DOUBLE", sortable=False)
    if kind in ("STRING", "BYTES"):
        raw = F.encode(value, "UTF-8") if kind == "STRING" else value
        return F.concat(varint_hex(F.octet_length(raw)), F.hex(raw))
    if kind == "UUID":
        return F.upper(F.replace(value, F.lit("-"), F.lit("")))
    return fixed_hex(F.unix_date(value) if kind == "LOCAL_DATE" else epoch_seconds(value, kind), 8)


def null_bitmap(values: Sequence[Column]) -> Column:
    """The bitmap alone, in hex."""
    parts = []
    for k in range(0, len(values), 8):
        parts.append(fixed_hex(sum((F.when(v.isNull(), 128 >> i).otherwise(0) for i, v in enumerate(values[k : k + 8])), F.lit(0)), 1))
    return F.concat(*parts) if parts else F.lit("")


def pack_row(columns: Sequence[RowColumn], values: Sequence[Column]) -> Column:
    """The packed row; a NULL in a column that has none fails the query."""
    if len(values) != len(columns):
        raise ValueError(f"{len(values)} values for {len(columns)} columns")
    parts = [null_bitmap(values)]
    for c, v in zip(columns, values, strict=True):
        absent = F.lit("") if c.nullable else F.raise_error(F.lit(f"{c.name} is not nullable, and a row has NULL there")).cast("string")
        parts.append(F.when(v.isNull(), absent).otherwise(_value_hex(v, c.type)))
    return F.unhex(F.concat(*parts))


def _decoded(raw: bytes, kind: str):
    if kind == "BOOLEAN":
        return raw != b"\x00"
    if kind in WIDTHS:
        return int.from_bytes(raw, "big", signed=True)
    if kind in ("FLOAT", "DOUBLE"):
        return struct.unpack(">f" if kind == "FLOAT" else ">d", raw)[0]
    if kind == "UUID":
        return str(uuid.UUID(bytes=raw))
    return int.from_bytes(raw, "big", signed=True)  # days, or seconds


def unpack_row_bytes(data: bytes, kinds: Sequence[str]) -> list:
    """For single rows on the driver."""
    at = (len(kinds) + 7) // 8
    if len(data) < at:
        raise ValueError("the bytes end inside the bitmap")
    out = []
    for i, kind in enumerate(kinds):
        if data[i // 8] & (128 >> (i % 8)):
            out.append(None)
            continue
        if kind in FIXED:
            size = FIXED[kind]
        else:
            size, at = read_varint(data, at)
        if size < 0 or at + size > len(data):
            raise ValueError("the bytes end inside a value")
        raw, at = data[at : at + size], at + size
        out.append(raw.decode("utf-8") if kind == "STRING" else raw if kind == "BYTES" else _decoded(raw, kind))
    return out


def unpack_row(columns: Sequence[RowColumn], packed: Column) -> Column:
    """A struct of the columns of a packed row; of a NULL row all are NULL."""
    kinds, names, missing = [c.type for c in columns], [c.name for c in columns], [None] * len(columns)

    @F.arrow_udf(", ".join(f"`{c.name}` {SPARK_TYPES[c.type]}" for c in columns))
    def decode(rows: pa.Array) -> pa.Array:
        return struct_array([unpack_row_bytes(r, kinds) if r is not None else missing for r in rows.to_pylist()], names, kinds)

    return decode(packed)
