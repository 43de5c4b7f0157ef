"""Streaming ingest: micro-batches of new documents are appended to a saved index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import TextIndex
from ..operators.pipeline import PipelineOptions


def stream_into_index(documents: DataFrame, path: str, checkpoint: str, options: PipelineOptions = PipelineOptions()) -> StreamingQuery:
    """Starts a query that appends each batch of (doc_id, text, ...) to the index at ``path``.

    Ids must be new: an append never rewrites. A batch that is replayed after a failure is known by the checkpoint and
    its number and not added again. ``availableNow`` drains what is there and stops.
    """

    def add(batch: DataFrame, number: int) -> None:
        TextIndex.append(batch.sparkSession, path, batch, options, batch=f"{checkpoint}#{number}")

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
