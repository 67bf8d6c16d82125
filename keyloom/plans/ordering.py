"""Key order as sort columns, as a comparison, and as positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.shared import cut
from keyloom.schema import TOO_LONG, IndexSpec, KeyColumn


def presence(column: Column, place: int, arity: Column | None) -> Column:
    """0 if the key ends before this column, 1 for NULL, 2 for a value: the order in which they sort when ascending."""
    here = F.when(column.isNull(), 1).otherwise(2)
    return here if arity is None else F.when(arity <= place, 0).otherwise(here)


def _compared(c: KeyColumn, column: Column) -> Column:
    return F.collate(column, c.collation) if c.collation else column


def sort_columns(spec: IndexSpec) -> list[Column]:
    """Sort columns of an index: NULLs first when ascending and last when descending; a short key before all its
    extensions when its first missing column ascends, after them when it descends."""
    out = []
    arity = F.col("_arity") if spec.short_keys else None
    for i, c in enumerate(spec.key):
        column = _compared(c, F.col(c.name))
        if arity is not None:
            p = presence(column, i, arity)
            out.append(p.desc() if c.descending else p.asc())
        out.append(column.desc_nulls_last() if c.descending else column.asc_nulls_first())
    return out


def compare_bytes(a: Column, b: Column, descending: bool = False) -> Column:
    """-1, 0 or 1 by unsigned bytes; shorter first on equal prefixes; the other way round when descending."""
    low, high = (1, -1) if descending else (-1, 1)
    return F.when(a < b, low).when(a > b, high).otherwise(0)


def compare_keys(spec: IndexSpec, a: Sequence[Column], b: Sequence[Column]) -> Column:
    """-1, 0 or 1 of two unpacked keys in the spec's order. b, or a, may have fewer columns: a short key."""
    if max(len(a), len(b)) > len(spec.key):
        raise ValueError(TOO_LONG)
    result = F.lit(0)
    for i in reversed(range(max(len(a), len(b)))):
        c = spec.key[i]
        less, greater = (1, -1) if c.descending else (-1, 1)
        if i >= len(a) or i >= len(b):
            result = F.lit(less if i >= len(a) else greater)
            continue
        x, y = _compared(c, a[i]), _compared(c, b[i])
        px, py = presence(x, i, None), presence(y, i, None)
        result = F.when(px < py, less).when(px > py, greater).when(x < y, less).when(x > y, greater).otherwise(result)
    return result


def same_key(names: Sequence[str], left: str, right: str) -> Column:
    """Equality of all key columns of two aliased tables; NULL equals NULL."""
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return same


def with_positions(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """df with the position of each row in the order, from 1, without gathering rows in one task.

    Rows are dealt into ranges and sorted there; the ranges' sizes, one row each, give where each range begins.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__n", F.monotonically_increasing_id()))
    part, place = F.shiftright("__n", 33), F.col("__n").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a range
    begins, total = [], 0
    for p, n in sizes:
        begins.append((p, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(begins, "__p bigint, __begin bigint"))
    return dealt.join(starts, part == F.col("__p")).withColumn(name, F.col("__begin") + place + 1).drop("__n", "__p", "__begin")
