"""Structured Streaming into a store: each micro-batch of quads is one set insert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import GraphStore


def ingest(stream: DataFrame, store: GraphStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of encoded quads (s, p, o, g) to the store.

    Set semantics make replayed batches harmless: what a restarted query writes again is there already.
    """
    writer = stream.select("s", "p", "o", "g").writeStream.foreachBatch(lambda df, _: store.insert_df(df) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
