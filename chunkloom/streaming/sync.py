"""Restartable incremental sync: new chunks stream in, and each micro-batch copies what the destination lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from chunkloom.sources.store import put_if_absent


def sync_stream(objects: DataFrame, table: str, checkpoint: str, hash: str = "sha256", once: bool = True) -> StreamingQuery:
    """Append a stream of (object, data) to a Parquet table of objects. A batch that runs again finds its objects there."""

    def copy(batch: DataFrame, _: int) -> None:
        put_if_absent(batch, table, hash)

    writer = objects.writeStream.option("checkpointLocation", checkpoint).foreachBatch(copy)
    return (writer.trigger(availableNow=True) if once else writer).start()
