"""Linking a stream of names against a prepared reference list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from namewright.plans.linker import Prepared


def link_stream(names: DataFrame, prepared: Prepared, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """names (a_id, a_name) as a stream: each micro-batch runs the batch plan and goes to the sink,
    which gets the batch's number and can write it once."""
    prepared.normalized.cache()
    writer = names.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: sink(prepared.link(rows), n))
    return (writer.trigger(availableNow=True) if once else writer).start()
