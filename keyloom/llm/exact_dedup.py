"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import attach, cut, quoted, table


def content_hash(text: Column) -> Column:
    """128 bits of a text, as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts have the same bytes; null counts as the empty text. In each group of equal texts the
    row with the smallest (or, with keep="largest", the largest) id stays; a null id sorts below all others. Of rows
    repeated with the same id and text exactly one is kept. Other columns are ignored, so their names cannot clash; an
    empty table gives an empty result.

    Only the 128-bit hash and the id travel with each row. The bytes are compared by grouping on (hash, text), which
    sends every distinct text once per task; a hash that holds two texts is split by SHA-256, and if even that does not
    separate them the query fails instead of merging them.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = cut(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), hashed(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("sha")))
    total = base.count()

    distinct = docs.select(hashed(text).alias("h"), text.alias("text")).groupBy("h", "text").agg(F.lit(1).alias("one"))
    mixed = cut(distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    collided = not mixed.isEmpty()
    if collided:
        apart = docs.select(hashed(text).alias("h"), text.alias("text")).join(mixed, "h", "left_semi").groupBy("h", "text").agg(F.lit(1).alias("one"))
        twice = apart.groupBy("h", F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n")).filter("n > 1")
        if not twice.isEmpty():
            raise ValueError("two different texts share both digests")
        split = mixed.withColumn("mixed", F.lit(True))
        base = base.join(split, "h", "left").withColumn("h", F.when(F.col("mixed"), F.concat("h", "sha")).otherwise(F.col("h"))).drop("mixed")

    best = F.max if keep == "largest" else F.min
    groups = base.groupBy("h").agg(best(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
    out = attach(base, groups, "h", "group_size", total)
    return out.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns (of types that can be ordered).

    Grouping on (hash, text) compares the bytes, and each task sends one row of a group at most. Null and empty texts are
    equal; of rows with the same id and text the one with the least (or largest) other columns stays.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    best = F.max if keep == "largest" else F.min
    row = F.struct(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("none"), F.struct(*[quoted(c) for c in docs.columns if c != text_col]).alias("rest"))
    kept = docs.select(content_hash(text).alias("h"), text.alias("text"), row.alias("row")).groupBy("h", "text").agg(best("row").alias("row"))
    value = F.when(~F.col("row.none"), F.col("text")).cast(docs.schema[text_col].dataType)
    return kept.select(*[value.alias(c) if c == text_col else F.col("row.rest")[c].alias(c) for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
