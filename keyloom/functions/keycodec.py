"""Keys as byte strings whose unsigned order is key order.

Each column is a flag (00 NULL, 01 value), the value's sortable bytes with 00 as 00FF, and 00 01 as its end; a descending
column is turned over, flag and all. A key that leaves out trailing columns ends there if the first missing column ascends,
and with FF FF FF, above all values and NULL, if it descends.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.primitives import escape_bytes, float_hex, invert_hex, sortable_hex, unescape
from keyloom.schema import SECONDS, SPARK_TYPES, TOO_LONG, IndexSpec, KeyColumn

WIDTHS = {"BYTE": 1, "SHORT": 2, "INT": 4, "LONG": 8}
END = "0001"


def epoch_seconds(value: Column, kind: str) -> Column:
    """Whole seconds since 1970, rounded down."""
    micros = F.unix_micros(value) if kind == "INSTANT" else F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), value)
    return F.floor((micros - F.pmod(micros, F.lit(1_000_000))) / 1_000_000).cast("bigint")


def value_hex(value: Column, kind: str) -> Column:
    """A value's sortable bytes in hex."""
    if kind == "BOOLEAN":
        return F.when(value, "01").otherwise("00")
    if kind in WIDTHS:
        return sortable_hex(value, WIDTHS[kind])
    if kind in ("FLOAT", "DOUBLE"):
        return float_hex(value, kind == "DOUBLE", sortable=True)
    if kind == "STRING":
        return F.hex(F.encode(value, "UTF-8"))
    if kind == "BYTES":
        return F.hex(value)
    if kind == "UUID":
        return F.upper(F.replace(value, F.lit("-"), F.lit("")))
    if kind == "LOCAL_DATE":
        return sortable_hex(F.unix_date(value), 8)
    return sortable_hex(epoch_seconds(value, kind), 8)


def _column_hex(c: KeyColumn, value: Column) -> Column:
    if c.collation:
        raise ValueError(f"{c.name}: collated columns can be ordered, not packed")
    packed = F.when(value.isNull(), F.lit("00" + END)).otherwise(F.concat(F.lit("01"), F.hex(escape_bytes(F.unhex(value_hex(value, c.type)))), F.lit(END)))
    return invert_hex(packed) if c.descending else packed


def pack(spec: IndexSpec, values: Sequence[Column]) -> Column:
    """The packed key of the given columns, which may be fewer than the spec's."""
    if len(values) > len(spec.key):
        raise ValueError(TOO_LONG)
    parts = [_column_hex(c, v) for c, v in zip(spec.key, values, strict=False)]
    if len(values) < len(spec.key) and spec.key[len(values)].descending:
        parts.append(F.lit("FFFFFF"))
    return F.unhex(F.concat(*parts)) if parts else F.lit(b"")


def _decoded(raw: bytes, kind: str):
    if kind == "BOOLEAN":
        return raw != b"\x00"
    if kind in WIDTHS:
        return int.from_bytes(raw, "big") - (1 << (8 * WIDTHS[kind] - 1))
    if kind in ("FLOAT", "DOUBLE"):
        n, size = int.from_bytes(raw, "big"), len(raw)
        top = 1 << (8 * size - 1)
        n = n ^ top if n & top else ~n & (2 * top - 1)
        return struct.unpack(">f" if size == 4 else ">d", n.to_bytes(size, "big"))[0]
    if kind == "STRING":
        return raw.decode("utf-8")
    if kind == "BYTES":
        return raw
    if kind == "UUID":
        if len(raw) != 16:
            raise ValueError("a UUID has 16 bytes")
        return str(uuid.UUID(bytes=raw))
    return int.from_bytes(raw, "big") - (1 << 63)  # days, or seconds


def unpack_bytes(data: bytes, columns: Sequence[tuple[str, bool]]) -> list:
    """For single keys on the driver: the values of a packed key, given (type, descending) of each column; None for NULL and for missing columns."""
    out, at = [], 0
    for kind, descending in columns:
        if at >= len(data) or (descending and data[at:] == b"\xff\xff\xff"):
            out.append(None)
            at = len(data)
            continue
        turned = bytes(255 - b for b in data[at:]) if descending else data[at:]
        end = 1
        while True:
            end = turned.find(b"\x00", end)
            if end < 0 or end + 1 >= len(turned):
                raise ValueError("a key column has no end")
            if turned[end + 1] == 0x01:
                break
            end += 2
        out.append(_decoded(unescape(turned[1:end]), kind) if turned[0] == 1 else None)
        at += end + 2
    return out


ARROW_TYPES = {
    "BOOLEAN": pa.bool_(),
    "BYTE": pa.int8(),
    "SHORT": pa.int16(),
    "INT": pa.int32(),
    "LONG": pa.int64(),
    "FLOAT": pa.float32(),
    "DOUBLE": pa.float64(),
    "STRING": pa.string(),
    "UUID": pa.string(),
    "BYTES": pa.binary(),
}


def struct_array(rows: Sequence[Sequence], names: Sequence[str], kinds: Sequence[str]) -> pa.Array:
    """Decoded rows as an Arrow struct. Through Arrow and not pandas, where NaN and NULL would be the same."""
    arrays = []
    for i, kind in enumerate(kinds):
        values = [r[i] for r in rows]
        if kind == "LOCAL_DATE":
            arrays.append(pa.array(values, pa.int32()).cast(pa.date32()))
        elif kind in SECONDS:
            arrays.append(pa.array([None if v is None else v * 1_000_000 for v in values], pa.int64()).cast(pa.timestamp("us", "UTC" if kind == "INSTANT" else None)))
        else:
            arrays.append(pa.array(values, ARROW_TYPES[kind]))
    return pa.StructArray.from_arrays(arrays, names)


def unpack(spec: IndexSpec, packed: Column) -> Column:
    """A struct of the key columns of a packed key; of a NULL key all are NULL.

    Through Arrow: the same said in SQL functions took twice the time.
    """
    if any(c.collation for c in spec.key):
        raise ValueError("collated columns can be ordered, not packed")
    columns = [(c.type, c.descending) for c in spec.key]
    names, missing = spec.key_names, [None] * len(spec.key)

    @F.arrow_udf(", ".join(f"`{c.name}` {SPARK_TYPES[c.type]}" for c in spec.key))
    def decode(keys: pa.Array) -> pa.Array:
        return struct_array([unpack_bytes(k, columns) if k is not None else missing for k in keys.to_pylist()], names, [k for k, _ in columns])

    return decode(packed)


def format_key(values: Sequence[Column]) -> Column:
    """Values for people to read, each followed by a bar, the last by a bar and a blank."""
    return F.concat(F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("null")) for v in values]), F.lit("| "))
