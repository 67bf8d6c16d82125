"""A query for each operator of the ordered index, over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.keycodec import format_key, pack, unpack
from keyloom.functions.primitives import escape_bytes, varint_length
from keyloom.functions.rowcodec import null_bitmap, pack_row, unpack_row
from keyloom.operators.index import OrderedIndex
from keyloom.plans.ordering import compare_bytes, compare_keys, with_positions
from keyloom.plans.shared import cut, remove, shared_folder
from keyloom.schema import IndexSpec, RowColumn, coerced, index_spec
from keyloom.sources.database import Database
from keyloom.sources.snapshots import commit_index


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BY_CUSTOMER = index_spec("orders_by_customer", [("o_custkey", "LONG"), ("o_orderkey", "LONG")], [("o_totalprice", "DOUBLE")])
BY_ORDER = index_spec("orders", [("o_orderkey", "LONG")], [("o_custkey", "LONG"), ("o_totalprice", "DOUBLE")])
BY_LINE = index_spec("lines", [("l_orderkey", "LONG"), ("l_linenumber", "INT")], [("l_partkey", "LONG"), ("l_suppkey", "LONG"), ("l_quantity", "DOUBLE")])
LINE_SEQ = "l_partkey * 1000000 + l_suppkey"  # tells lines of one key apart


def _orders(spark: SparkSession, sf_dir: str, spec: IndexSpec = BY_ORDER) -> OrderedIndex:
    return OrderedIndex.from_dataframe(_table(spark, sf_dir, "orders"), spec, F.col("o_orderkey"))


def _lines(spark: SparkSession, sf_dir: str) -> OrderedIndex:
    return OrderedIndex.from_dataframe(_table(spark, sf_dir, "lineitem"), BY_LINE, F.expr(LINE_SEQ))


def traverse_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, BY_CUSTOMER).positions().drop("_seq")


PRIORITY = index_spec("by_priority", [("o_orderpriority", "STRING", True), ("o_orderkey", "LONG")])


def traverse_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, PRIORITY).positions().drop("_seq")


def traverse_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = index_spec("nulls", [("up", "STRING"), ("down", "STRING", True), ("o_orderkey", "LONG")])
    orders = _table(spark, sf_dir, "orders").select(F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("up"), F.nullif("o_orderstatus", F.lit("F")).alias("down"), "o_orderkey")
    return OrderedIndex.from_dataframe(orders, spec, F.col("o_orderkey")).positions().drop("_seq")


def traverse_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in an order without regard to case, and in upper and lower case by turns."""
    spec = index_spec("words", [("word", "STRING", False, "UNICODE_CI"), ("n_nationkey", "INT")])
    nations = _table(spark, sf_dir, "nation").select(F.expr("CASE WHEN n_nationkey % 2 = 0 THEN upper(regexp_replace(n_name, '[^A-Za-z]', '')) ELSE lower(regexp_replace(n_name, '[^A-Za-z]', '')) END").alias("word"), "n_nationkey")
    return OrderedIndex.from_dataframe(nations, spec, F.col("n_nationkey")).positions().drop("_seq")


def first_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, BY_CUSTOMER).first().drop("_seq")


def lookup_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).lookup(5).drop("_seq")


def lookup_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).lookup(-5).drop("_seq")


def lookup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2 - 21).alias("o_orderkey"))
    return _orders(spark, sf_dir).lookup_many(keys)


def lookup_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return _lines(spark, sf_dir).lookup_many(keys)


def lookup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order is entered under its customer alone; a short key meets only these."""
    spec = IndexSpec("short", BY_CUSTOMER.key, BY_CUSTOMER.row, short_keys=True)
    orders = _table(spark, sf_dir, "orders")
    index = OrderedIndex.from_dataframe(orders, spec, F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(2))
    keys = orders.select("o_custkey").distinct().select("o_custkey", F.lit(None).cast("bigint").alias("o_orderkey"), F.lit(1).alias("_arity"))
    return index.lookup_many(keys).select("o_custkey", "found", "o_totalprice")


def insertion_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, BY_CUSTOMER).insertion_rank(75, 7000)


def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").filter("o_orderkey % 100 = 1").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return _orders(spark, sf_dir).insert(rows, F.col("o_orderkey")).positions().drop("_seq")


def insert_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").filter("o_orderkey % 100 = 1").withColumn("o_totalprice", -F.col("o_totalprice"))
    return _orders(spark, sf_dir).insert(rows, F.col("o_orderkey")).positions().drop("_seq")


def delete_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 2").select("o_orderkey")
    return _orders(spark, sf_dir).delete(keys).df.drop("_seq")


def delete_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry less of each key, two of every fourth order's."""
    keys = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return _lines(spark, sf_dir).delete(keys.unionByName(keys.filter("l_orderkey % 4 = 0"))).df.drop("_seq")


def delete_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "orders").select((-F.col("o_orderkey") - 1).alias("o_orderkey"))
    return _orders(spark, sf_dir).delete(keys).df.drop("_seq")


def update_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    new = keys.select("*", F.lit(-1).cast("bigint").alias("l_partkey"), F.lit(-2).cast("bigint").alias("l_suppkey"), F.lit(0.5).alias("l_quantity"))
    return _lines(spark, sf_dir).update(new, F.lit(0)).df.drop("_seq")


def update_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _table(spark, sf_dir, "orders").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit(0).cast("bigint").alias("o_custkey"), F.lit(0.0).alias("o_totalprice"))
    return _orders(spark, sf_dir).update(requests, F.col("o_orderkey")).df.drop("_seq")


def _moves(spark: SparkSession, sf_dir: str, to: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 3")
    moves = orders.select("o_orderkey", F.expr(to).alias("new_o_orderkey"), "o_custkey", F.lit(1.25).alias("o_totalprice"))
    absent = moves.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "new_o_orderkey", "o_custkey", "o_totalprice")
    return _orders(spark, sf_dir).rekey(moves.unionByName(absent), F.col("o_orderkey")).positions().drop("_seq")


def update_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir, "o_orderkey + 50000000")


def update_rekey_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir, "o_orderkey - 1")


def _ranks(df: DataFrame, packed) -> DataFrame:
    """The dense rank of each row's packed key."""
    keyed = df.withColumn("packed", packed)
    ranks = with_positions(keyed.select("packed").distinct(), [F.col("packed").asc()], "packed_rank")
    return keyed.join(ranks, "packed").drop("packed")


MANY = index_spec("many", [("d", "LOCAL_DATE", True), ("s", "STRING"), ("i", "INT", True), ("b", "BOOLEAN"), ("l", "LONG")])
MANY_COLUMNS = ["CAST(o_orderdate AS DATE) AS d", "nullif(o_orderpriority, '3-MEDIUM') AS s", "CAST(o_custkey - 700 AS INT) AS i", "o_orderkey % 2 = 0 AS b", "o_orderkey - 7000 AS l"]


def key_encode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").selectExpr(*MANY_COLUMNS)
    return _ranks(rows, pack(MANY, [F.col(c.name) for c in MANY.key]))


FLOATS = index_spec("floats", [("x", "DOUBLE", True), ("y", "FLOAT")])


def key_encode_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_discount - 0.05 * (l_linenumber % 2) AS x", "CAST(l_quantity - 25 AS FLOAT) AS y").distinct()
    return _ranks(rows, pack(FLOATS, [F.col("x"), F.col("y")]))


def key_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = index_spec("events", [("event_type", "STRING", True), ("value", "DOUBLE"), ("ts", "LOCAL_DATE_TIME", True), ("event_id", "LONG")])
    events = _table(spark, sf_dir, "events")
    values = [coerced(F.nullif("event_type", F.lit("click")) if c.name == "event_type" else F.col(c.name), c.type) for c in spec.key]
    return events.select(pack(spec, values).alias("packed")).select(unpack(spec, F.col("packed")).alias("k")).select("k.*")


UUIDS = index_spec("uuids", [("u", "UUID"), ("k", "LONG", True)])


def key_encode_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed, ranked by the packed bytes, and unpacked again."""
    rows = _table(spark, sf_dir, "orders").select(F.regexp_replace(F.upper(F.md5((F.col("o_custkey") % 97).cast("string").cast("binary"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5").alias("u"), F.col("o_orderkey").alias("k"))
    packed = rows.select(pack(UUIDS, [coerced(F.col("u"), "UUID"), F.col("k")]).alias("packed"))
    ranks = with_positions(packed, [F.col("packed").asc()], "packed_rank")
    return ranks.select(unpack(UUIDS, F.col("packed")).alias("key"), "packed_rank").select("key.*", "packed_rank")


BYTES = index_spec("bytes", [("b", "BYTES", True), ("s", "SHORT"), ("y", "BYTE", True)])
BYTES_COLUMNS = ["unhex(hex(p_brand) || repeat('00', CAST(p_partkey % 3 AS INT))) AS b", "CAST(p_partkey % 2000 - 1000 AS SMALLINT) AS s", "CAST((p_size * 5) % 256 - 128 AS TINYINT) AS y", "p_partkey"]


def key_encode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").selectExpr(*BYTES_COLUMNS).withColumn("b", F.nullif("b", F.unhex(F.hex(F.lit("Brand#11")))))
    return _ranks(rows, pack(BYTES, [F.col("b"), F.col("s"), F.col("y")])).select("p_partkey", "packed_rank")


def compare_bytes_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against the next part's, as bytes, ascending and descending."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("x"))
    other = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    joined = parts.join(other, "p_partkey")
    return joined.select("p_partkey", compare_bytes(F.col("x"), F.col("y")).alias("up"), compare_bytes(F.col("x"), F.col("y"), descending=True).alias("down"))


CUSTOMER = [RowColumn("c_custkey", "LONG", False), RowColumn("c_name", "STRING"), RowColumn("c_nationkey", "INT"), RowColumn("c_acctbal", "DOUBLE"), RowColumn("segment", "STRING")]


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))


def row_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _customers(spark, sf_dir).select(pack_row(CUSTOMER, [F.col(c.name) for c in CUSTOMER]).alias("packed"))
    return packed.select(unpack_row(CUSTOMER, F.col("packed")).alias("r")).select("r.*")


def row_null_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps of nine columns: the ninth opens a second byte."""
    columns = [F.nullif(F.col("c_custkey") % (k + 2), F.lit(0)) for k in range(9)]
    return _customers(spark, sf_dir).select("c_custkey", null_bitmap(columns).alias("bitmap"))


def key_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's key against the next order's, packed and unpacked."""
    spec = index_spec("pairs", [("s", "STRING", True), ("c", "LONG")])
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("s"), F.col("o_custkey").alias("c"))
    a, b = orders.alias("a"), orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), "s", "c").alias("b")
    key = lambda t: [F.col(f"{t}.s"), F.col(f"{t}.c")]
    joined = a.join(b, F.col("a.o_orderkey") == F.col("b.o_orderkey"))
    return joined.select(F.col("a.o_orderkey").alias("o_orderkey"), compare_bytes(pack(spec, key("a")), pack(spec, key("b"))).alias("packed"), compare_keys(spec, key("a"), key("b")).alias("unpacked"), compare_keys(spec, key("a"), key("b")[:1]).alias("against_short"))


def key_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", format_key([F.col("o_custkey"), F.col("o_orderpriority")]).alias("formatted"))


def bytes_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of escaped bytes: one more for each zero byte."""
    raw = F.concat(F.encode(F.col("p_name"), "UTF-8"), F.unhex(F.expr("repeat('00', cast(p_partkey % 4 as int))")), F.unhex(F.lit("A00B00FF")))
    return _table(spark, sf_dir, "part").select("p_partkey", F.octet_length(escape_bytes(raw)).alias("n_bytes"))


def varint_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") * F.col("o_orderkey") % 300_000_000).cast("int")
    return _table(spark, sf_dir, "orders").select("o_orderkey", varint_length(n).alias("n_bytes"))


def temporal_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", coerced(F.col("ts"), "LOCAL_DATE_TIME").alias("second"))


def date_epoch_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint").alias("day"))


def size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).size()


def snapshot_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as sorted ranges, opened again, changed, written again, and traversed."""
    path = shared_folder(spark, "orders-index")
    index = commit_index(_orders(spark, sf_dir), path, 4)
    keys = _table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 2").select("o_orderkey")
    out = cut(commit_index(index.delete(keys), path, 4).df.drop("_seq"))
    remove(spark, path)
    return out


def stored_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry, one entry by its key and a range, of a stored index whose manifest says which files to read."""
    path = shared_folder(spark, "orders-index")
    index = commit_index(_orders(spark, sf_dir, BY_CUSTOMER), path, 6)
    reads = {"first": index.first(), "range": index.between([20], [40, 3000])}
    tagged = [df.drop("_seq").select(F.lit(name).alias("read"), "*") for name, df in reads.items()]
    out = cut(tagged[0].unionByName(tagged[1]))
    remove(spark, path)
    return out


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a stored index, summed up."""
    path = shared_folder(spark, "orders-index")
    layout = commit_index(_orders(spark, sf_dir, BY_CUSTOMER), path, 4).layout()
    whole = layout.agg(F.sum("entries").alias("entries"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.sum("nulls").alias("nulls"), F.min("bounds.o_orderkey.least").alias("least_order"))
    out = cut(whole.select("*", (F.lit(layout.filter("bytes > 0").count()) > 1).alias("several_files")))
    remove(spark, path)
    return out


def create_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database of two indexes, of which one is filled and the other dropped."""
    path = shared_folder(spark, "database")
    db = Database(spark, path)
    db.create_index(BY_ORDER)
    db.create_index(BY_CUSTOMER)
    index = db.open_index("orders")
    db.commit(index.insert(_table(spark, sf_dir, "orders"), F.col("o_orderkey")), 2)
    db.drop_index("orders_by_customer")
    sizes = [(name, db.stats(name)["entries"], db.open_index(name).size().first()["size"]) for name in db.names()]
    remove(spark, path)
    return spark.createDataFrame(sizes, "name string, entries bigint, size bigint")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fails, with the kind of error: over-long keys, short keys where there are none, NULL where none may be, what is
    defined twice or not at all."""
    index, path = _orders(spark, sf_dir), shared_folder(spark, "database")
    db = Database(spark, path)
    db.create_index(BY_ORDER)
    stale = db.open_index("orders")
    db.commit(db.open_index("orders"))
    no_null = index_spec("no_null", [("o_orderkey", "LONG")], [("c", "LONG", False)])
    holed = _table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_custkey", "o_custkey").alias("c"))
    tries = {
        "long_lookup": lambda: index.lookup(1, 2),
        "short_lookup": lambda: index.lookup(),
        "long_rank": lambda: index.insertion_rank(1, 2),
        "long_range": lambda: index.between([1, 2]),
        "long_pack": lambda: pack(BY_ORDER, [F.lit(1), F.lit(2)]),
        "null_value": lambda: OrderedIndex.from_dataframe(holed, no_null).df.agg(F.max("c")).collect(),
        "created_twice": lambda: db.create_index(BY_ORDER),
        "no_such_index": lambda: db.open_index("none"),
        "stale_commit": lambda: db.commit(stale),
        "bad_type": lambda: index_spec("x", [("a", "DECIMAL")]),
        "good_lookup": lambda: index.lookup(1),
    }

    def fails(f) -> bool:
        try:
            f()
        except (ValueError, PySparkException):
            return True
        return False

    found = [(name, fails(f)) for name, f in tries.items()]
    remove(spark, path)
    return spark.createDataFrame(found, "what string, fails boolean")


def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: entries between two keys."""
    return _orders(spark, sf_dir, BY_CUSTOMER).between([100], [200, 5000]).drop("_seq")


NAMES = [
    traverse_asc, traverse_mixed, traverse_nulls, traverse_collated, first_entry, lookup_hit, lookup_miss, lookup_batch, lookup_duplicate, lookup_prefix, insertion_rank, insert_new,
    insert_duplicate, delete_one, delete_dup, delete_missing, update_value, update_missing, update_rekey, update_rekey_collision, key_encode_order, key_encode_float, key_roundtrip,
    row_roundtrip, row_null_bitmap, key_compare, key_format, bytes_escape, varint_len, temporal_second, date_epoch_day, size, snapshot_reopen, range_scan,
    key_encode_uuid, key_encode_bytes, compare_bytes_desc, stored_reads, store_stats, create_drop, errors,
]
QUERIES = {f.__name__: f for f in NAMES}

_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey * 1000000 + l_suppkey) AS n FROM lineitem"
_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
_MOVED = """SELECT row_number() OVER (ORDER BY o_orderkey, late) AS pos, o_orderkey, o_custkey, o_totalprice FROM (
  SELECT o_orderkey, o_custkey, o_totalprice, 0 AS late FROM orders WHERE o_orderkey % 10 <> 3
  UNION ALL SELECT {to}, o_custkey, 1.25, 1 FROM orders WHERE o_orderkey % 10 = 3)"""

ORACLE_SQL = {
    "traverse_asc": "SELECT row_number() OVER (ORDER BY o_custkey NULLS FIRST, o_orderkey NULLS FIRST) AS pos, o_custkey, o_orderkey, o_totalprice FROM orders",
    "traverse_mixed": "SELECT row_number() OVER (ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey NULLS FIRST) AS pos, o_orderpriority, o_orderkey FROM orders",
    "traverse_nulls": "SELECT row_number() OVER (ORDER BY up NULLS FIRST, down DESC NULLS LAST, o_orderkey NULLS FIRST) AS pos, up, down, o_orderkey FROM (SELECT nullif(o_orderpriority, '1-URGENT') AS up, nullif(o_orderstatus, 'F') AS down, o_orderkey FROM orders)",
    "traverse_collated": "SELECT row_number() OVER (ORDER BY lower(word), n_nationkey) AS pos, word, n_nationkey FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN upper(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) ELSE lower(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) END AS word, n_nationkey FROM nation)",
    "first_entry": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey NULLS FIRST, o_orderkey NULLS FIRST LIMIT 1",
    "lookup_hit": f"{_ORDERS} WHERE o_orderkey = 5",
    "lookup_miss": f"{_ORDERS} WHERE o_orderkey = -5",
    "lookup_batch": "SELECT k.o_orderkey, o.o_orderkey IS NOT NULL AS found, o.o_custkey, o.o_totalprice FROM (SELECT o_orderkey * 2 - 21 AS o_orderkey FROM orders) k LEFT JOIN orders o ON o.o_orderkey = k.o_orderkey",
    "lookup_duplicate": f"SELECT l_orderkey, l_linenumber, true AS found, l_partkey, l_suppkey, l_quantity FROM ({_LINES}) WHERE n = 1",
    "lookup_prefix": "SELECT c.o_custkey, o.o_orderkey IS NOT NULL AS found, o.o_totalprice FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 3 = 0) o ON o.o_custkey = c.o_custkey AND o.n = 1",
    "insertion_rank": "SELECT count(*) AS rank FROM orders WHERE o_custkey < 75 OR (o_custkey = 75 AND o_orderkey < 7000)",
    "insert_new": f"SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, * FROM ({_ORDERS} UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 100 = 1)",
    "insert_duplicate": "SELECT row_number() OVER (ORDER BY o_orderkey, late) AS pos, o_orderkey, o_custkey, o_totalprice FROM (SELECT o_orderkey, o_custkey, o_totalprice, 0 AS late FROM orders UNION ALL SELECT o_orderkey, o_custkey, -o_totalprice, 1 FROM orders WHERE o_orderkey % 100 = 1)",
    "delete_one": f"{_ORDERS} WHERE o_orderkey % 5 <> 2",
    "delete_dup": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM ({_LINES}) WHERE n > CASE WHEN l_orderkey % 4 = 0 THEN 2 ELSE 1 END",
    "delete_missing": _ORDERS,
    "update_value": f"SELECT l_orderkey, l_linenumber, CASE WHEN hit THEN -1 ELSE l_partkey END AS l_partkey, CASE WHEN hit THEN -2 ELSE l_suppkey END AS l_suppkey, CASE WHEN hit THEN 0.5::DOUBLE ELSE l_quantity END AS l_quantity FROM (SELECT *, n = 1 AS hit FROM ({_LINES}))",
    "update_missing": _ORDERS,
    "update_rekey": _MOVED.format(to="o_orderkey + 50000000"),
    "update_rekey_collision": _MOVED.format(to="o_orderkey - 1"),
    "key_encode_order": f"SELECT *, dense_rank() OVER (ORDER BY d DESC NULLS LAST, s NULLS FIRST, i DESC NULLS LAST, b NULLS FIRST, l NULLS FIRST) AS packed_rank FROM (SELECT {', '.join(MANY_COLUMNS)} FROM orders)",
    "key_encode_float": "SELECT *, dense_rank() OVER (ORDER BY x DESC NULLS LAST, y NULLS FIRST) AS packed_rank FROM (SELECT DISTINCT l_discount - 0.05::DOUBLE * (l_linenumber % 2) AS x, CAST(l_quantity - 25 AS FLOAT) AS y FROM lineitem)",
    "key_roundtrip": "SELECT nullif(event_type, 'click') AS event_type, value, date_trunc('second', ts) AS ts, event_id FROM events",
    "row_roundtrip": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer",
    "row_null_bitmap": "SELECT c_custkey, printf('%02X', " + " + ".join(f"CASE WHEN c_custkey % {k + 2} = 0 THEN {128 >> k} ELSE 0 END" for k in range(8)) + ") || CASE WHEN c_custkey % 10 = 0 THEN '80' ELSE '00' END AS bitmap FROM customer",
    "key_compare": """
WITH k AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS s, o_custkey AS c FROM orders),
p AS (SELECT a.o_orderkey, a.s AS s1, a.c AS c1, b.s AS s2, b.c AS c2 FROM k a JOIN k b ON b.o_orderkey = a.o_orderkey + 1),
r AS (SELECT *, CASE WHEN s1 IS NOT DISTINCT FROM s2 THEN 0 WHEN s1 IS NULL THEN 1 WHEN s2 IS NULL THEN -1 WHEN s1 > s2 THEN -1 ELSE 1 END AS first FROM p),
f AS (SELECT o_orderkey, first, CASE WHEN first <> 0 THEN first WHEN c1 < c2 THEN -1 WHEN c1 > c2 THEN 1 ELSE 0 END AS whole FROM r)
SELECT o_orderkey, whole AS packed, whole AS unpacked, CASE WHEN first <> 0 THEN first ELSE 1 END AS against_short FROM f""",
    "key_format": "SELECT o_orderkey, o_custkey || '|' || o_orderpriority || '| ' AS formatted FROM orders",
    "bytes_escape": "SELECT p_partkey, (octet_length(encode(p_name)) + 2 * (p_partkey % 4) + 5)::INT AS n_bytes FROM part",
    "varint_len": "SELECT o_orderkey, CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 WHEN n < 268435456 THEN 4 ELSE 5 END AS n_bytes FROM (SELECT o_orderkey, o_orderkey * o_orderkey % 300000000 AS n FROM orders)",
    "temporal_second": "SELECT event_id, date_trunc('second', ts) AS second FROM events",
    "date_epoch_day": "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS day FROM orders",
    "size": "SELECT count(*) AS size FROM lineitem",
    "snapshot_reopen": f"{_ORDERS} WHERE o_orderkey % 5 <> 2",
    "range_scan": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey >= 100 AND (o_custkey < 200 OR (o_custkey = 200 AND o_orderkey < 5000))",
    "key_encode_uuid": "SELECT u, k, row_number() OVER (ORDER BY u, k DESC) AS packed_rank FROM (SELECT regexp_replace(md5((o_custkey % 97)::VARCHAR), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS u, o_orderkey AS k FROM orders)",
    "key_encode_bytes": f"SELECT p_partkey, dense_rank() OVER (ORDER BY nullif(b, unhex(hex('Brand#11'))) DESC NULLS LAST, s NULLS FIRST, y DESC NULLS LAST) AS packed_rank FROM (SELECT {', '.join(BYTES_COLUMNS)} FROM part)",
    "compare_bytes_desc": "SELECT a.p_partkey, CASE WHEN encode(a.p_name) < encode(b.p_name) THEN -1 WHEN encode(a.p_name) > encode(b.p_name) THEN 1 ELSE 0 END AS up, CASE WHEN encode(a.p_name) < encode(b.p_name) THEN 1 WHEN encode(a.p_name) > encode(b.p_name) THEN -1 ELSE 0 END AS down FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
    "stored_reads": "(SELECT 'first' AS read, o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey LIMIT 1) UNION ALL SELECT 'range', o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey >= 20 AND (o_custkey < 40 OR (o_custkey = 40 AND o_orderkey < 3000))",
    "store_stats": "SELECT count(*) AS entries, min(o_custkey) AS least, max(o_custkey) AS largest, count_if(o_custkey IS NULL)::BIGINT AS nulls, min(o_orderkey) AS least_order, true AS several_files FROM orders",
    "create_drop": "SELECT 'orders' AS name, count(*) AS entries, count(*) AS size FROM orders",
    "errors": "SELECT * FROM (VALUES ('long_lookup', true), ('short_lookup', true), ('long_rank', true), ('long_range', true), ('long_pack', true), ('null_value', true), ('created_twice', true), ('no_such_index', true), ('stale_commit', true), ('bad_type', true), ('good_lookup', false)) AS t(what, fails)",
}
