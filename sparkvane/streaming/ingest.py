"""Continuous upserts: each micro-batch becomes one transaction of a mutation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import validate
from ..sources.log import MutationLog


def stream_into(docs: DataFrame, log: MutationLog, checkpoint: str, available_now: bool = True, dimensions: dict[str, int] | None = None) -> StreamingQuery:
    """Start a query that upserts a stream of documents.

    A batch's number gives the transaction's, counted from the log's state when the stream first started (kept beside the checkpoint),
    and a committed transaction is never written again: a batch replayed after a failure has no second effect. The log must
    have no other writer while the stream exists.
    """
    path, id_col = log.path, log.id_col
    offset = _first_transaction(log, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        target = MutationLog(batch.sparkSession, path, id_col)
        good, _ = validate(batch, id_col, dimensions)
        target.add(good, tx=offset + number + 1)

    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _first_transaction(log: MutationLog, checkpoint: str) -> int:
    """The log's last transaction at the stream's first start, remembered as the name of a folder."""
    path = log.spark._jvm.org.apache.hadoop.fs.Path
    root = path(f"{checkpoint.rstrip('/')}-start")
    fs = root.getFileSystem(log.spark._jsc.hadoopConfiguration())
    if fs.exists(root):
        known = [int(s.getPath().getName()) for s in fs.listStatus(root)]
        if known:
            return min(known)
    last = max(log.transactions(), default=0)
    fs.mkdirs(path(f"{checkpoint.rstrip('/')}-start/{last}"))
    return last
