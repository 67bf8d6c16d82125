"""Indexes on disk: snapshots of range-partitioned, sorted Parquet, each with a manifest, and a file for each commit.

A commit writes a whole new snapshot and its manifest (entries, bytes and key bounds of each file), and then the commit's
own file under the next number. That file can be made only once, so that of two writers of one state the second fails
instead of undoing the first; readers always see the state of the largest number. Files hold disjoint key ranges in
order: the manifest leads lookups to the files that can hold a key, and the rest are not opened.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.index import OrderedIndex
from keyloom.plans.ordering import sort_columns
from keyloom.schema import IndexSpec

COMMITS = "_commits"
#: Conditions that leave more files than this are left to the scan of all.
MOST_FILES = 10_000


class IndexStoreError(ValueError):
    """There is no index, or what is stored of it is damaged or was changed meanwhile."""


class Folder:
    """Small files in a folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, path
        self.fs = self._p("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._p(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._p(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A new file, whole when it is first seen. False if there is one of this name."""
        where = self._p(name)
        temporary = self.jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4()}")
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        try:
            context.rename(temporary, where, options)
        except Py4JJavaError as error:
            self.fs.delete(temporary, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._p(name), True)

    def names(self, name: str = "") -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self._p(name))] if self.exists(name) else []


@dataclass(frozen=True)
class Commit:
    """What a commit's file says: the snapshot's and the manifest's folders, sizes, the next place in insertion order, and the
    last batch of each stream that is in it."""

    number: int
    data: str
    manifest: str
    spec: str
    files: int
    entries: int
    bytes: int
    next_seq: int
    batches: dict[str, int]


def last_commit(spark: SparkSession, path: str) -> Commit | None:
    """The commit of the largest number, or None if there is no index at path."""
    folder = Folder(spark, path)
    numbers = [int(n) for n in folder.names(COMMITS) if n.isdigit()]
    if not numbers:
        return None
    try:
        return Commit(**json.loads(folder.read(f"{COMMITS}/{max(numbers):09d}")))
    except (ValueError, TypeError, Py4JJavaError) as error:
        raise IndexStoreError(f"commit {max(numbers)} at {path} is damaged") from error


@dataclass(frozen=True)
class Stored:
    """The files of a snapshot, by their manifest: file, entries, bytes, and of the first key column least, largest, nulls."""

    manifest: DataFrame
    schema: object

    def only(self, condition: Column) -> DataFrame | None:
        """The entries of the files that fit; None if these are too many to list."""
        spark = self.manifest.sparkSession
        files = [r["file"] for r in self.manifest.filter(condition).select("file").limit(MOST_FILES + 1).collect()]
        if len(files) > MOST_FILES:
            return None
        return spark.read.schema(self.schema).parquet(*files) if files else spark.createDataFrame([], self.schema)


def create_index(spark: SparkSession, path: str, spec: IndexSpec, files: int = 1) -> OrderedIndex:
    """A new, empty index at path."""
    if last_commit(spark, path) is not None:
        raise IndexStoreError(f"there is an index at {path}")
    return commit_index(OrderedIndex.empty(spark, spec), path, files)


def open_index(spark: SparkSession, path: str) -> OrderedIndex:
    """The index at path as last committed. A snapshot that lacks files is an error."""
    commit = last_commit(spark, path)
    if commit is None:
        raise IndexStoreError(f"there is no index at {path}")
    names = Folder(spark, path).names(commit.data)
    if "_SUCCESS" not in names or sum(n.startswith("part-") for n in names) != commit.files:
        raise IndexStoreError(f"the snapshot of commit {commit.number} at {path} lacks files")
    spec = IndexSpec.from_json(commit.spec)
    schema = OrderedIndex.empty(spark, spec).df.schema
    manifest = spark.read.parquet(f"{path}/{commit.manifest}")
    return OrderedIndex(spec, spark.read.schema(schema).parquet(f"{path}/{commit.data}"), Stored(manifest, schema), commit.number, commit.next_seq)


def _manifest(df: DataFrame, spec: IndexSpec) -> DataFrame:
    """A row for each file of a stored snapshot."""
    first = spec.key_names[0]
    bounds = F.struct(*[F.struct(F.min(c).alias("least"), F.max(c).alias("largest"), F.count_if(F.col(c).isNull()).alias("nulls")).alias(c) for c in spec.key_names])
    return df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(
        F.count("*").alias("entries"), F.min(first).alias("least"), F.max(first).alias("largest"), F.count_if(F.col(first).isNull()).alias("nulls"), bounds.alias("bounds"), F.max("_seq").alias("last_seq")
    )


def commit_index(index: OrderedIndex, path: str, files: int | None = None, keep: int = 2, batch: tuple[str, int] | None = None) -> OrderedIndex:
    """Write index as the next state of the one at path; the last keep snapshots stay for readers that still use them.

    An index that came from an opened one can follow only that very state: if another commit came between, this fails and
    nothing changes. batch names a stream and the number of its batch that this commit applies.
    """
    spark = index.df.sparkSession
    folder = Folder(spark, path)
    before = last_commit(spark, path)
    if before is not None and IndexSpec.from_json(before.spec) != index.spec:
        raise IndexStoreError("the index at this path is defined otherwise")
    number = before.number + 1 if before else 0
    if index.base is not None and index.base != number - 1:
        raise IndexStoreError("the index was changed since this state of it was opened")
    name = f"{number:09d}-{uuid.uuid4()}"
    order = [*sort_columns(index.spec), index.df["_seq"].asc()]
    dealt = index.df.repartitionByRange(files, *order) if files else index.df.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.parquet(f"{path}/snapshot-{name}")
    written = spark.read.schema(OrderedIndex.empty(spark, index.spec).df.schema).parquet(f"{path}/snapshot-{name}")
    _manifest(written, index.spec).coalesce(1).write.parquet(f"{path}/manifest-{name}")
    totals = spark.read.parquet(f"{path}/manifest-{name}").agg(F.coalesce(F.sum("entries"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("last_seq") + 1, F.lit(0))).first()
    n_files = sum(n.startswith("part-") for n in folder.names(f"snapshot-{name}"))
    batches = dict(before.batches if before else {}) | (dict([batch]) if batch else {})
    commit = Commit(number, f"snapshot-{name}", f"manifest-{name}", index.spec.to_json(), n_files, totals[0], totals[1], max(totals[2], before.next_seq if before else 0), batches)
    if not folder.create(f"{COMMITS}/{number:09d}", json.dumps(asdict(commit))):
        folder.delete(commit.data)
        folder.delete(commit.manifest)
        raise IndexStoreError("the index was changed while this state of it was written")
    for old in folder.names():
        kind, _, rest = old.partition("-")
        if kind in ("snapshot", "manifest") and int(rest[:9]) <= number - keep:
            folder.delete(old)
    for old in folder.names(COMMITS):
        if old.isdigit() and int(old) <= number - keep:
            folder.delete(f"{COMMITS}/{old}")
    return open_index(spark, path)
