"""Streams of entries into a stored index. Beyond the reference, which has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyloom.sources.snapshots import commit_index, last_commit, open_index


def ingest(stream: DataFrame, path: str, checkpoint: str, op_col: str = "op", once: bool = True) -> StreamingQuery:
    """Apply a stream of rows with an operation (insert, delete or update) to the index at path, a commit a micro-batch.

    Within a batch deletes come first, then updates, then inserts. The index keeps the number of the last batch of each
    stream (told apart by checkpoint), so that a batch which is given again after a crash is passed over. Rows for an
    index with short keys have _arity. Each commit writes the whole index anew: batches should be large.
    """

    def apply(batch: DataFrame, number: int) -> None:
        commit = last_commit(batch.sparkSession, path)
        if commit is not None and commit.batches.get(checkpoint, -1) >= number:
            return
        batch.persist()
        index = open_index(batch.sparkSession, path)
        of = lambda name: batch.filter(F.col(op_col) == name).drop(op_col)
        arity = F.col("_arity") if index.spec.short_keys and "_arity" in batch.columns else None
        changed = index.delete(of("delete")).update(of("update")).insert(of("insert"), arity=arity)
        commit_index(changed, path, batch=(checkpoint, number))
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
