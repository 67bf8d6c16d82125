"""The ordered index: a multimap from typed keys to rows, as a DataFrame that operations turn into a new one.

The DataFrame has the key columns, the row columns, _seq (insertion order, which settles which of several equal keys an
operation meets: always the lowest) and, where keys may be short, _arity (how many key columns an entry has).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.plans.ordering import compare_keys, sort_columns, with_positions
from keyloom.schema import SPARK_TYPES, TOO_LONG, IndexSpec, checked, coerced

if TYPE_CHECKING:
    from keyloom.sources.snapshots import Stored


@dataclass(frozen=True)
class OrderedIndex:
    """spec and entries. An opened index also has its files; it and what is made from it know which commit they follow
    (base) and, until rows are inserted, the next place in insertion order."""

    spec: IndexSpec
    df: DataFrame
    stored: Stored | None = None
    base: int | None = None
    next_seq: int | None = None

    # -- making one

    @staticmethod
    def _columns(df: DataFrame, spec: IndexSpec, order: Column, arity: Column | None, prefix: str = "") -> list[Column]:
        """An index's columns of rows that are named as in spec, key columns after a prefix."""
        key = [coerced(F.col(prefix + c.name), c.type) for c in spec.key]
        if not spec.short_keys:
            return [*[c.alias(k.name) for c, k in zip(key, spec.key, strict=True)], *checked(df, spec.row), order.alias("_seq")]
        a = F.lit(len(spec.key)) if arity is None else arity
        short = [F.when(a > i, c).alias(k.name) for i, (c, k) in enumerate(zip(key, spec.key, strict=True))]
        return [*short, *checked(df, spec.row), order.alias("_seq"), a.cast("int").alias("_arity")]

    @staticmethod
    def from_dataframe(df: DataFrame, spec: IndexSpec, seq: Column | None = None, arity: Column | None = None) -> OrderedIndex:
        """An index over df, whose columns are named as in spec. seq gives insertion order; else it is as df comes."""
        order = F.monotonically_increasing_id() if seq is None else seq.cast("bigint")
        return OrderedIndex(spec, df.select(*OrderedIndex._columns(df, spec, order, arity)))

    def _with(self, df: DataFrame, next_seq: int | None = None) -> OrderedIndex:
        return replace(self, df=df, stored=None, next_seq=next_seq)

    @staticmethod
    def empty(spark, spec: IndexSpec) -> OrderedIndex:
        fields = [f"`{c.name}` {SPARK_TYPES[c.type]}" for c in (*spec.key, *spec.row)] + ["_seq bigint"] + ["_arity int"] * spec.short_keys
        return OrderedIndex(spec, spark.createDataFrame([], ", ".join(fields)))

    @property
    def identity(self) -> list[str]:
        """The columns that make two keys equal."""
        return [*self.spec.key_names, *(["_arity"] if self.spec.short_keys else [])]

    def _same(self, left: DataFrame, right: DataFrame) -> Column:
        same = F.lit(True)
        for n in self.identity:
            same = same & left[n].eqNullSafe(right[n])
        return same

    def _keys(self, keys: DataFrame) -> DataFrame:
        """keys with the index's key types, and with _arity if the index has it."""
        columns = [coerced(F.col(c.name), c.type).alias(c.name) for c in self.spec.key]
        if self.spec.short_keys:
            columns.append((F.col("_arity") if "_arity" in keys.columns else F.lit(len(self.spec.key))).cast("int").alias("_arity"))
        return keys.select(*columns, *[c for c in keys.columns if c not in (*self.spec.key_names, "_arity")])

    # -- reading

    def traverse(self) -> DataFrame:
        """All entries in key order, equal keys by insertion."""
        return self.df.orderBy(*sort_columns(self.spec), "_seq")

    def positions(self, name: str = "pos") -> DataFrame:
        """All entries with their position in the traversal, from 1."""
        return with_positions(self.df, [*sort_columns(self.spec), F.col("_seq").asc()], name)

    def _entries(self, condition: Column | None) -> DataFrame:
        """The entries, of a stored index those in files whose manifest fits the condition."""
        some = self.stored.only(condition) if self.stored is not None and condition is not None else None
        return self.df if some is None else some

    def first(self) -> DataFrame:
        """The entry with the least key, or none. Of a stored index only the first file is read, or those that share its bound."""
        condition, c = None, self.spec.key[0]
        if self.stored is not None and not c.collation:
            ends = self.stored.manifest.agg(F.sum("nulls").alias("nulls"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.max("entries")).first()
            edge = ends["largest"] if c.descending else ends["least"]
            if edge is None or (ends["nulls"] and not c.descending):
                condition = F.col("nulls") > 0
            else:
                condition = F.col("largest" if c.descending else "least").eqNullSafe(F.lit(edge))
        return replace(self, df=self._entries(condition)).traverse().limit(1)

    def size(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("size"))

    def _matches(self, key: Sequence) -> Column:
        """Equality with a key, by value; of a short key only with entries of the same length."""
        if len(key) > len(self.spec.key) or (len(key) < len(self.spec.key) and not self.spec.short_keys):
            raise ValueError(TOO_LONG if len(key) > len(self.spec.key) else "this index has no short keys")
        same = F.lit(True)
        for c, v in zip(self.spec.key, key, strict=False):
            same = same & F.col(c.name).eqNullSafe(coerced(F.lit(v), c.type))
        return same & (F.col("_arity") == len(key)) if self.spec.short_keys else same

    def lookup(self, *key) -> DataFrame:
        """The entry of a key, the first inserted if there are several, or none. The key reaches the scan as a filter, and of a
        stored index only files that can hold it are read."""
        matches, condition = self._matches(key), None
        if key:
            value = coerced(F.lit(key[0]), self.spec.key[0].type)
            condition = F.when(value.isNull(), F.col("nulls") > 0).otherwise((F.col("least") <= value) & (F.col("largest") >= value))
        return self._entries(condition).filter(matches).orderBy("_seq").limit(1)

    def lookup_many(self, keys: DataFrame) -> DataFrame:
        """Each row of keys with found and the row columns of its entry, the first inserted; NULLs if there is none."""
        wanted = self._keys(keys)
        distinct = wanted.select(*self.identity).distinct()
        inside = self.df.join(distinct, self._same(self.df, distinct), "left_semi")
        row = F.struct("_seq", *self.spec.row_names)
        best = inside.groupBy(*self.identity).agg(F.min_by(row, "_seq").alias("__row"))
        joined = wanted.join(best, self._same(wanted, best), "left")
        return joined.select(*[wanted[c] for c in wanted.columns], F.col("__row").isNotNull().alias("found"), *[F.col(f"__row.{c}").alias(c) for c in self.spec.row_names])

    def _literal(self, key: Sequence) -> list[Column]:
        if len(key) > len(self.spec.key):
            raise ValueError(TOO_LONG)
        return [coerced(F.lit(v), c.type) for c, v in zip(self.spec.key, key, strict=False)]

    def insertion_rank(self, *key) -> DataFrame:
        """rank: how many entries have a lesser key."""
        if self.spec.short_keys:
            raise ValueError("ranks among short keys are those of positions()")
        mine = [F.col(c.name) for c in self.spec.key]
        less = F.when(compare_keys(self.spec, mine, self._literal(key)) < 0, 1).otherwise(0)
        return self.df.agg(F.coalesce(F.sum(less), F.lit(0)).cast("bigint").alias("rank"))

    def between(self, low: Sequence | None = None, high: Sequence | None = None) -> DataFrame:
        """Entries from key low up to, not with, key high, in key order. Beyond the reference.

        What the bounds say of the first key column alone stands as a filter of its own, which reaches the scan; of a stored
        index only the files that can hold such values are read.
        """
        mine, c = [F.col(c.name) for c in self.spec.key], self.spec.key[0]
        inside, condition = F.lit(True), F.lit(True)
        plain = c.collation is None and c.type not in ("FLOAT", "DOUBLE")
        for key, begins in ((low, True), (high, False)):
            if key is None:
                continue
            bound, place = self._literal(key), compare_keys(self.spec, mine[: len(key)], self._literal(key))
            inside = inside & (place >= 0 if begins else place < 0)
            if key and plain and key[0] is not None:
                # at the side where NULLs sort they stay
                from_below = begins != c.descending
                side = mine[0] >= bound[0] if from_below else mine[0] <= bound[0]
                file_side = F.col("largest") >= bound[0] if from_below else F.col("least") <= bound[0]
                inside = inside & (side if begins != c.descending else side | mine[0].isNull())
                condition = condition & (file_side if begins != c.descending else file_side | (F.col("nulls") > 0))
        return replace(self, df=self._entries(condition).filter(inside)).traverse()

    def layout(self) -> DataFrame:
        """How entries lie: for each file of a stored index, and else for each partition of the DataFrame, its entries and the
        least and largest first key column; of files also bytes and the bounds of each key column."""
        if self.stored is not None:
            return self.stored.manifest.drop("last_seq")
        name = self.spec.key_names[0]
        place = F.spark_partition_id().alias("partition")
        return self.df.groupBy(place).agg(F.count("*").alias("entries"), F.min(name).alias("least"), F.max(name).alias("largest"))

    # -- changing: each returns a new index

    def _next_seq(self) -> int:
        if self.next_seq is not None:
            return self.next_seq
        top = self.df.agg(F.max("_seq")).first()[0]
        return 0 if top is None else top + 1

    def insert(self, rows: DataFrame, seq: Column | None = None, arity: Column | None = None) -> OrderedIndex:
        """All rows added after what is there; equal keys are kept side by side. seq gives the order among the rows."""
        new = OrderedIndex.from_dataframe(rows, self.spec, seq, arity)
        return self._with(self.df.unionByName(new.df.withColumn("_seq", F.col("_seq") + self._next_seq())))

    def _numbered(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The entries whose keys are in wanted, numbered among their equals (__n), with how often they are wanted (__k); and all
        others. One join with the keys, counted first: only entries that are wanted are sorted."""
        counts = wanted.groupBy(*[F.col(n).alias(f"__c_{n}") for n in self.identity]).agg(F.count("*").alias("__k"))
        same = F.lit(True)
        for n in self.identity:
            same = same & F.col(n).eqNullSafe(F.col(f"__c_{n}"))
        joined = self.df.join(counts, same, "left").select(*self.df.columns, "__k")
        touched = joined.filter("__k is not null").withColumn("__n", F.row_number().over(Window.partitionBy(*self.identity).orderBy("_seq")))
        return touched, joined.filter("__k is null").drop("__k")

    def delete(self, keys: DataFrame) -> OrderedIndex:
        """One entry less for each row of keys that has one: of equal keys the first inserted go. Other keys do nothing."""
        touched, rest = self._numbered(self._keys(keys))
        return self._with(rest.unionByName(touched.filter("__n > __k").select(*self.df.columns)), self.next_seq)

    def _requested(self, touched: DataFrame, wanted: DataFrame, order: Column | None, values) -> DataFrame:
        """touched with values(request) as __new where there is one: requests of one key, in order, go to its first, second ...
        entry."""
        wanted = wanted.withColumn("__order", F.monotonically_increasing_id() if order is None else order.cast("bigint"))
        wanted = wanted.withColumn("__m", F.row_number().over(Window.partitionBy(*self.identity).orderBy("__order")))
        new = wanted.select(*[F.col(n).alias(f"__key_{n}") for n in self.identity], "__m", F.struct(*values(wanted)).alias("__new"))
        same = F.col("__n") == F.col("__m")
        for n in self.identity:
            same = same & F.col(n).eqNullSafe(F.col(f"__key_{n}"))
        return touched.join(new, same, "left")

    def _replaced(self, joined: DataFrame, names: Sequence[str]) -> DataFrame:
        """The entries, with the columns of the names from their request if they have one."""
        value = lambda c: F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
        return joined.select(*map(value, self.df.columns))

    def update(self, requests: DataFrame, order: Column | None = None) -> OrderedIndex:
        """New row values for existing keys. requests has the key columns and the row columns; missing keys do nothing.

        Several requests for one key go, in order, to its first, second ... entry.
        """
        wanted = self._keys(requests)
        touched, rest = self._numbered(wanted)
        if not self.spec.row:
            return self
        joined = self._requested(touched, wanted, order, lambda df: checked(df, self.spec.row))
        return self._with(rest.unionByName(self._replaced(joined, self.spec.row_names)), self.next_seq)

    def rekey(self, requests: DataFrame, order: Column | None = None) -> OrderedIndex:
        """Entries moved to other keys. requests has the key columns, the new key as new_<column> (new__arity: how many of them,
        on an index with short keys; else all), and the row columns.

        Each request takes one entry of its key away and, only if there was one, inserts the new key after all others, beside
        any equal one. All requests see the index as it is now.
        """
        wanted = self._keys(requests)
        touched, rest = self._numbered(wanted)
        next_seq = self._next_seq()

        def entry(df: DataFrame) -> list[Column]:
            arity = F.col("new__arity") if "new__arity" in df.columns else None
            return self._columns(df, self.spec, F.col("__order") + next_seq, arity, "new_")

        joined = self._requested(touched, wanted, order, entry)
        return self._with(rest.unionByName(self._replaced(joined, self.df.columns)))
