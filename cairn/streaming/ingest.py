"""Continuous ingest into a collection by Structured Streaming; each micro-batch is applied exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from cairn.sources.collection import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, name: str = "stream", checkpoint_every: int = 20, once: bool = True) -> StreamingQuery:
    """Upsert the stream's records (id, vector, metadata). Of an id that a micro-batch holds twice, one row is applied.

    The manifest keeps the last number of each stream, so a micro-batch that is replayed does nothing, also after a checkpoint.
    After ``checkpoint_every`` batches in the log the collection is checkpointed, which also brings its index up to date.
    """

    def apply(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy("id").orderBy(F.xxhash64("vector", "metadata"))
        rows = batch.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
        if not rows.isEmpty():
            collection.insert(rows, upsert=True, batch=(name, number))
        if len(collection.m["ops"]) >= checkpoint_every:
            collection.checkpoint()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
