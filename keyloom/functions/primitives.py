"""Byte-level building blocks, on hex strings inside Catalyst: escaping, inversion, varints, sortable numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VARINT_LIMITS = (1 << 7, 1 << 14, 1 << 21, 1 << 28)


#: Decoded so, each byte is one character, and bytes can be searched and replaced as text.
BYTEWISE = "ISO-8859-1"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, as SQL has no local names inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def escape_bytes(value: Column) -> Column:
    """Each byte 00 as 00FF, so that 00 followed by anything else can end a value."""
    return F.encode(F.replace(F.decode(value, BYTEWISE), F.lit("\x00"), F.lit("\x00\xff")), BYTEWISE)


def unescape(value: bytes) -> bytes:
    return value.replace(b"\x00\xff", b"\x00")


def invert_hex(digits: Column) -> Column:
    """All bits turned over."""
    return F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210")


def fixed_hex(value: Column, width: int) -> Column:
    """The low width bytes of an integer, big-endian."""
    return F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(2 * width))


def sortable_hex(value: Column, width: int) -> Column:
    """An integer with its sign bit flipped: unsigned byte order is then number order."""
    if width == 8:
        return fixed_hex(value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")), 8)
    return fixed_hex(value.cast("bigint") + (1 << (8 * width - 1)), width)


def varint_length(n: Column) -> Column:
    """Bytes that n takes as an unsigned LEB128 of 32 bits; a negative n takes five."""
    out = F.lit(5)
    for size, limit in reversed(list(enumerate(VARINT_LIMITS, 1))):
        out = F.when((n >= 0) & (n < limit), size).otherwise(out)
    return out


def varint_hex(n: Column) -> Column:
    """n as an unsigned LEB128 of 32 bits."""
    bits = n.cast("bigint").bitwiseAND((1 << 32) - 1)
    group = lambda k: F.shiftright(bits, 7 * k).bitwiseAND(127)
    part = lambda k, size: fixed_hex(group(k) + (128 if k < size - 1 else 0), 1)
    size = varint_length(n)
    out = F.concat(*[part(k, 5) for k in range(5)])
    for s in (4, 3, 2, 1):
        out = F.when(size == s, F.concat(*[part(k, s) for k in range(s)])).otherwise(out)
    return out


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place after it."""
    value = 0
    for k in range(5):
        if at + k >= len(data):
            raise ValueError("the bytes end inside a varint")
        b = data[at + k]
        value |= (b & 127) << (7 * k)
        if b < 128:
            return (value & 0xFFFFFFFF) - ((value & 0x80000000) << 1), at + k + 1
    raise ValueError("varint too long")


def float_bits(values: np.ndarray, kind: str, sortable: bool) -> list[bytes]:
    """IEEE bits, big-endian. Sortable: negatives turned over and positives with the sign bit set, -0.0 as 0.0, NaN (one of
    them) above all. The array's bytes are taken at once: single numpy scalars are in native order."""
    whole, sign = (np.uint32, 31) if kind == "f4" else (np.uint64, 63)
    v = values.astype(kind)
    if sortable:
        v = np.where(v == 0, np.zeros(1, kind), v).astype(kind)
        v[np.isnan(v)] = np.nan
        bits = v.view(whole)
        top = whole(1) << whole(sign)
        bits = np.where(bits & top, ~bits, bits | top).astype(whole)
    else:
        bits = v.view(whole)
    raw, size = bits.astype(bits.dtype.newbyteorder(">")).tobytes(), whole(0).nbytes
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def _float_udf(kind: str, sortable: bool):
    @F.pandas_udf("binary")
    def bits(values: pd.Series) -> pd.Series:
        return pd.Series(float_bits(values.to_numpy(kind), kind, sortable), dtype=object)

    return bits


def float_hex(value: Column, double: bool, sortable: bool) -> Column:
    """No SQL function shows IEEE bits, so this is the one Arrow UDF of the encoders. NULL has to be dealt with outside."""
    return F.hex(_float_udf("f8" if double else "f4", sortable)(F.coalesce(value, F.lit(0.0).cast("double" if double else "float"))))
