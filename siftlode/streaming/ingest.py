"""Micro-batches of a stream into an index."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Index
from ..sources.blobs import backend_for


def ingest(stream: DataFrame, target: Index, checkpoint: str, key: str = "doc_id", text: str = "text", **trigger) -> StreamingQuery:
    """Starts a query that adds every micro-batch as one segment.

    The manifest remembers the last batch of each stream, by the identity that Spark keeps in its checkpoint, so a batch that
    is replayed after a failure is added once, and streams of different checkpoints do not meet.
    """

    def add(rows: DataFrame, batch: int) -> None:
        identity = json.loads(backend_for(target.spark, checkpoint).read("metadata"))["id"]
        target.add_many(rows, batch=batch, stream=identity, key=key, text=text)

    writer = stream.select(key, text).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
