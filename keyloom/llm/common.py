"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.primitives import let
from keyloom.plans.shared import cut, remove, shared_folder

__all__ = ["GAP", "WORD", "attach", "cut", "give_back", "kept_columns", "let", "quoted", "remove", "shared_folder", "table", "words"]

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Give free memory back to the system: a Python worker waits for other tasks, beside other workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_columns(names: Sequence[str]) -> Column:
    """The struct keep, in which an operator passes on columns of its input without a clash of names."""
    return (F.struct(*map(quoted, names)) if names else F.lit(None).cast("struct<>")).alias("keep")


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with groups (one row a key, with its number of rows in size), safe under hot keys.

    Keys with over total / 10,000 rows number at most 10,000 whatever the data, so these groups are broadcast and
    their rows never move; all other keys have few enough rows for an ordinary shuffle join.
    """
    limit = max(total // 10_000, 100)
    payload = F.struct(*[F.col(c) for c in groups.columns if c != key]).alias("__payload")
    packed = groups.select(key, size, payload)
    hot = packed.filter(F.col(size) > limit).select(F.col(key).alias("__key"), F.col("__payload"))
    cold = packed.filter(F.col(size) <= limit).select(F.col(key).alias("__key"), F.col("__payload"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left").drop("__key")
    rest = marked.filter(F.col("__payload").isNull()).drop("__payload")
    done = marked.filter(F.col("__payload").isNotNull())
    both = done.unionByName(rest.join(cold, F.col(key) == F.col("__key"), "left").drop("__key"))
    return both.select(*rows.columns, *[F.col(f"__payload.{c}").alias(c) for c in groups.columns if c != key])
