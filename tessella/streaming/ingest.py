"""Files that arrive in a directory are synced batch by batch; state stays in the snapshot store's manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.plans.knowledge import KnowledgeBase

SCHEMA = "doc_id string, text string, deleted boolean"


def stream_documents(base: KnowledgeBase, directory: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply JSON records (doc_id, text, deleted) as they come; the last record of a batch for a document wins.

    A micro-batch that is tried again finds its documents unchanged and changes nothing, so each takes effect once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max_by(F.struct("text", "deleted"), F.struct("file_time", "file", "text")).alias("r"))
        new = last.select("doc_id", F.col("r.text").alias("text"), F.coalesce("r.deleted", F.lit(False)).alias("deleted"))
        base.apply_changes(new, now=number)

    source = base.spark.readStream.schema(SCHEMA).json(directory).select("*", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file"))
    writer = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
