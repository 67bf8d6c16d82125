"""Key and row codecs, comparisons and primitives."""

import datetime as dt
import itertools
import math
import uuid

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions import keycodec, primitives, rowcodec
from keyloom.plans.ordering import compare_bytes, compare_keys
from keyloom.schema import SPARK_TYPES, RowColumn, coerced, index_spec

D, TS = dt.date, dt.datetime
VALUES = {
    "BOOLEAN": [False, True],
    "BYTE": [-128, -1, 0, 1, 127],
    "SHORT": [-32768, -1, 0, 255, 256, 32767],
    "INT": [-(2**31), -256, -1, 0, 1, 256, 2**31 - 1],
    "LONG": [-(2**63), -1, 0, 1, 256, 2**63 - 1],
    "FLOAT": [-math.inf, -1.5, -(2.0**-100), 0.0, 2.0**-100, 2.5, math.inf, math.nan],
    "DOUBLE": [-math.inf, -1e300, -1.0, 0.0, 1e-300, 1.0, math.inf, math.nan],
    "STRING": ["", "\x00", "\x00\x01", "A", "a", "a\x00", "a\x00b", "ab", "한글", "￿", "🎉日本語"],
    "LOCAL_DATE": [D(1, 1, 1), D(1697, 12, 25), D(1969, 12, 31), D(1970, 1, 1), D(2025, 4, 30)],
    "LOCAL_DATE_TIME": [TS(1969, 12, 31, 23, 59, 59), TS(1970, 1, 1), TS(2024, 2, 29, 12, 0, 1)],
    "INSTANT": [TS(1969, 12, 31, 23, 59, 59), TS(1970, 1, 1), TS(2024, 2, 29, 12, 0, 1)],
    "UUID": [str(uuid.UUID(int=n)) for n in (0, 255, 256, 2**127, 2**128 - 1)],
    "BYTES": [b"", b"\x00", b"\x00\xff", b"\x01", b"\x7f", b"\x80", b"\xff", b"\xff\xff"],
}


def frame(spark, kinds, rows):
    schema = T.StructType([T.StructField("n", T.IntegerType())] + [T.StructField(f"c{i}", T._parse_datatype_string(SPARK_TYPES[k])) for i, k in enumerate(kinds)])
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], schema)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a):
        return math.isnan(b)
    return a == b


@pytest.mark.parametrize("descending", [False, True])
def test_packed_order_and_round_trip_of_every_type(spark, descending):
    for kind, values in VALUES.items():
        spec = index_spec("k", [("c0", kind, descending), ("c1", "INT")])
        rows = [(v, w) for v in [None, *values] for w in (None, 3)]
        packed = keycodec.pack(spec, [F.col("c0"), F.col("c1")])
        out = frame(spark, [kind, "INT"], rows).select("n", packed.alias("p")).select("n", "p", keycodec.unpack(spec, F.col("p")).alias("k")).collect()
        assert all(same(rows[r["n"]][0], r["k"]["c0"]) or isinstance(r["k"]["c0"], bytearray) and bytes(r["k"]["c0"]) == rows[r["n"]][0] for r in out), kind
        assert all(rows[r["n"]][1] == r["k"]["c1"] for r in out)
        by_bytes = [r["n"] for r in sorted(out, key=lambda r: bytes(r["p"]))]
        order = list(range(len(rows)))
        if descending:
            order = [2 * i + j for i in reversed(range(len(rows) // 2)) for j in (0, 1)]
        assert by_bytes == order, kind


def test_floats_as_keys():
    bits = lambda *v: primitives.float_bits(np.array(v), "f8", True)
    assert bits(0.0) == bits(-0.0) and bits(math.nan) == bits(-math.nan)
    v = [-math.inf, -1.0, -1e-300, 0.0, 1e-300, 1.0, math.inf, math.nan]
    assert bits(*v) == sorted(bits(*v))


def test_short_keys(spark):
    spec = index_spec("k", [("a", "INT"), ("b", "LONG"), ("c", "INT", True)])
    a, b, c = F.lit(10), F.lit(5230).cast("bigint"), F.lit(None).cast("int")
    one, two, three = (keycodec.pack(spec, k) for k in ([a], [a, b], [a, b, c]))
    r = spark.range(1).select(compare_bytes(one, two).alias("x"), compare_bytes(two, three).alias("y"), compare_keys(spec, [a], [a, b]).alias("u"), compare_keys(spec, [a, b], [a, b, c]).alias("v"), keycodec.unpack(spec, one).alias("k"), keycodec.unpack(spec, two).alias("l")).first()
    assert (r["x"], r["y"]) == (r["u"], r["v"]) == (-1, 1)
    assert tuple(r["k"]) == (10, None, None) and tuple(r["l"]) == (10, 5230, None)
    with pytest.raises(ValueError, match="more values"):
        keycodec.pack(spec, [a] * 4)
    with pytest.raises(ValueError, match="more values"):
        compare_keys(spec, [a] * 4, [a])


@pytest.mark.parametrize("kinds", [("INT", "LONG"), ("STRING", "BOOLEAN"), ("BYTE", "SHORT"), ("FLOAT", "DOUBLE"), ("LOCAL_DATE", "LOCAL_DATE_TIME"), ("INSTANT", "BYTES"), ("UUID", "STRING")])
def test_both_comparisons_agree(spark, kinds):
    rows = list(itertools.product([None, *VALUES[kinds[0]][:4]], [None, *VALUES[kinds[1]][-4:]]))
    for down in ((False, False), (True, True), (True, False)):
        spec = index_spec("k", [("c0", kinds[0], down[0]), ("c1", kinds[1], down[1])])
        df = frame(spark, kinds, rows)
        other = df.select(*[F.col(c).alias(f"o_{c}") for c in df.columns])
        both = df.join(other, F.expr("(n * 7 + o_n * 3) % 5 < 3"))
        key = lambda p: [F.col(f"{p}c0"), F.col(f"{p}c1")]  # noqa: B023,E731
        wrong = both.select(compare_keys(spec, key(""), key("o_")).alias("u"), compare_bytes(keycodec.pack(spec, key("")), keycodec.pack(spec, key("o_"))).alias("p"), (F.col("n") == F.col("o_n")).alias("same"))
        assert wrong.filter("u <> p or (same <> (u = 0))").count() == 0


def test_decoding_agrees_with_the_plain_decoders(spark):
    """Random values of all types, bit patterns of floats among them."""
    rng = np.random.default_rng(8)
    kinds = list(VALUES)
    doubles = rng.integers(0, 2**64, 400, dtype=np.uint64).view(np.float64).tolist() + [5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -0.0]
    floats = [float(x) for x in rng.integers(0, 2**32, 400, dtype=np.uint32).view(np.float32)] + [1e-45, -1e-45, 0.0, 1.1754943508222875e-38, 3.4028234663852886e38]
    rows = [tuple(floats[n] if k == "FLOAT" else doubles[n] if k == "DOUBLE" else bytes(rng.integers(0, 3, rng.integers(0, 9)).astype(np.uint8) * 127) if k == "BYTES" else rng.choice(np.array(VALUES[k], object)) if rng.random() > 0.2 else None for k in kinds) for n in range(405)]
    down = [bool(i % 2) for i in range(len(kinds))]
    spec = index_spec("all", [(f"c{i}", k, d) for i, (k, d) in enumerate(zip(kinds, down, strict=True))])
    columns = [RowColumn(f"c{i}", k) for i, k in enumerate(kinds)]
    key, row = keycodec.pack(spec, [F.col(c.name) for c in spec.key]), rowcodec.pack_row(columns, [F.col(c.name) for c in columns])
    df = frame(spark, kinds, rows).select("n", key.alias("key"), row.alias("row")).select("*", keycodec.unpack(spec, F.col("key")).alias("k"), rowcodec.unpack_row(columns, F.col("row")).alias("r"))
    day, epoch = dt.date(1970, 1, 1), dt.datetime(1970, 1, 1)

    def plain(values):
        out = []
        for v, k in zip(values, kinds, strict=True):
            out.append(v if v is None else day + dt.timedelta(v) if k == "LOCAL_DATE" else epoch + dt.timedelta(seconds=v) if k in ("LOCAL_DATE_TIME", "INSTANT") else v)
        return out

    for r in df.collect():
        for got, want in ((r["k"], keycodec.unpack_bytes(bytes(r["key"]), list(zip(kinds, down)))), (r["r"], rowcodec.unpack_row_bytes(bytes(r["row"]), kinds))):
            got = [bytes(v) if isinstance(v, bytearray) else v for v in got]
            assert all(same(a, b) and (not isinstance(a, float) or math.isnan(a) or math.copysign(1, a) == math.copysign(1, b)) for a, b in zip(plain(want), got)), (r["n"], plain(want), got)


def test_very_long_values(spark):
    """No expression may go deeper with the length of a value."""
    text = "x\x00y" * 400_000
    spec = index_spec("k", [("s", "STRING", True), ("b", "BYTES"), ("n", "INT")])
    columns = [RowColumn("s", "STRING"), RowColumn("b", "BYTES")]
    df = spark.createDataFrame([(text, bytearray(b"\x00" * 500_000), 7)], "s string, b binary, n int")
    r = df.select(keycodec.unpack(spec, keycodec.pack(spec, [F.col("s"), F.col("b"), F.col("n")])).alias("k"), rowcodec.unpack_row(columns, rowcodec.pack_row(columns, [F.col("s"), F.col("b")])).alias("r")).first()
    assert r["k"]["s"] == r["r"]["s"] == text and bytes(r["k"]["b"]) == bytes(r["r"]["b"]) == b"\x00" * 500_000 and r["k"]["n"] == 7


def test_null_and_broken_bytes(spark):
    spec, columns = index_spec("k", [("s", "STRING"), ("n", "INT", True)]), [RowColumn("s", "STRING"), RowColumn("n", "INT")]
    none = spark.sql("SELECT CAST(NULL AS BINARY) p").select(keycodec.unpack(spec, F.col("p")).alias("k"), rowcodec.unpack_row(columns, F.col("p")).alias("r")).first()
    assert tuple(none["k"]) == tuple(none["r"]) == (None, None)
    for data, decode, what in ((b"\x01ab", keycodec.unpack(spec, F.col("p")), "no end"), (b"\x40\x05a", rowcodec.unpack_row(columns, F.col("p")), "end inside"), (b"\x80\x00\x01", rowcodec.unpack_row(columns, F.col("p")), "end inside")):
        with pytest.raises(PySparkException, match=what):
            spark.createDataFrame([(bytearray(data),)], "p binary").select(decode.alias("x")).collect()


def test_collated_keys_are_ordered_not_packed():
    spec = index_spec("k", [("a", "STRING", False, "UNICODE")])
    with pytest.raises(ValueError, match="ordered, not packed"):
        keycodec.pack(spec, [None])


def test_rows_round_trip(spark):
    kinds = [*VALUES, "INT"]
    columns = [RowColumn(f"c{i}", k) for i, k in enumerate(kinds)]
    rows = [tuple(VALUES[k][n % len(VALUES[k])] for k in kinds) for n in range(11)]
    rows += [tuple(None if (i + n) % 3 == 0 else VALUES[k][-1] for i, k in enumerate(kinds)) for n in range(3)] + [(None,) * len(kinds)]
    packed = rowcodec.pack_row(columns, [F.col(c.name) for c in columns])
    out = frame(spark, kinds, rows).select("n", packed.alias("p")).select("n", "p", rowcodec.unpack_row(columns, F.col("p")).alias("r")).collect()
    for r in out:
        got = [bytes(v) if isinstance(v, bytearray) else v for v in r["r"]]
        want = [x if not isinstance(x, float) or k != "FLOAT" or math.isnan(x) or math.isinf(x) else float(np.float32(x)) for x, k in zip(rows[r["n"]], kinds)]
        assert all(same(a, b) for a, b in zip(want, got)), (want, got)
    assert bytes(out[-1]["p"]) == b"\xff\xfc"


def test_null_bitmap_at_the_edge_of_a_byte(spark):
    for n, last in ((8, b"\x01"), (9, b"\x00\x80")):
        columns = [RowColumn(f"c{i}", "BYTE") for i in range(n)]
        values = [F.lit(1).cast("tinyint")] * (n - 1) + [F.lit(None).cast("tinyint")]
        assert bytes(spark.range(1).select(rowcodec.pack_row(columns, values).alias("p")).first()["p"]) == last + b"\x01" * (n - 1)


def test_row_errors(spark):
    columns = [RowColumn("a", "INT", False)]
    with pytest.raises(ValueError, match="values for"):
        rowcodec.pack_row(columns, [])
    with pytest.raises(PySparkException, match="a is not nullable"):
        spark.range(1).select(rowcodec.pack_row(columns, [F.lit(None).cast("int")])).collect()
    for data, kinds in ((b"", ["INT"]), (b"\x00\x01", ["INT"]), (b"\x00\x05a", ["STRING"])):
        with pytest.raises(ValueError):
            rowcodec.unpack_row_bytes(data, kinds)
    with pytest.raises(ValueError, match="no end"):
        keycodec.unpack_bytes(b"\x01ab", [("STRING", False)])


def test_varints_and_escapes(spark):
    numbers = [0, 1, 40, 50, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 2**31 - 1, -1, -(2**31)]
    df = spark.createDataFrame([(n,) for n in numbers], "n int")
    for r in df.select("n", F.unhex(primitives.varint_hex(F.col("n"))).alias("b"), primitives.varint_length(F.col("n")).alias("s")).collect():
        assert primitives.read_varint(bytes(r["b"]), 0) == (r["n"], len(r["b"])) and r["s"] == len(r["b"])
    with pytest.raises(ValueError, match="too long"):
        primitives.read_varint(b"\xff" * 6, 0)
    with pytest.raises(ValueError, match="inside"):
        primitives.read_varint(b"\xff", 0)
    raw = [b"", b"\x00", b"\xa0\x0b\x00\xff", b"\x00\x00\x10\x00", b"\x0a\x00", b"\x10\x01"]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary")
    for r in df.select("b", primitives.escape_bytes(F.col("b")).alias("e")).collect():
        assert bytes(r["e"]) == bytes(r["b"]).replace(b"\x00", b"\x00\xff") and primitives.unescape(bytes(r["e"])) == bytes(r["b"])


def test_seconds_are_rounded_down(spark):
    r = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:58.7' a, timestamp'2020-01-01 00:00:00.999' b").select(coerced(F.col("a"), "LOCAL_DATE_TIME").alias("a"), coerced(F.col("b"), "INSTANT").alias("b"), keycodec.epoch_seconds(F.col("a"), "LOCAL_DATE_TIME").alias("s"))
    assert tuple(r.first()) == (TS(1969, 12, 31, 23, 59, 58), TS(2020, 1, 1), -2) and dict(r.dtypes) == {"a": "timestamp_ntz", "b": "timestamp", "s": "bigint"}


def test_format(spark):
    assert spark.range(1).select(keycodec.format_key([F.lit(1), F.lit("x")]).alias("f")).first()["f"] == "1|x| "
