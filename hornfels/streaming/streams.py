"""Structured Streaming: each micro-batch of facts is an epoch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from hornfels.streaming.client import Client


def stream_into(client: Client, stream: DataFrame, to_facts: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that commits an epoch for each micro-batch of ``stream``.

    ``to_facts`` turns a batch into facts (:func:`hornfels.sources.facts.from_columns`).  A batch that is delivered
    again after a failure brings no facts that are not there already, so it adds nothing.  To go on after a restart the
    client needs a log folder of its own (``log=``), since the checkpoint does not deliver what was committed again.
    """

    def batch(df: DataFrame, _: int) -> None:
        client.insert_frame(to_facts(df))
        client.commit()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
