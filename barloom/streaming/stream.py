"""Structured Streaming jobs that keep a keyed table up to date from micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.keyed import newest
from ..operators.keyed_table import KeyedTable

def run_batches(source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drive a stream over all that is available now; run again with the same checkpoint, it goes on where it stopped."""
    query = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_upsert(source: DataFrame, table: KeyedTable, keys: list[str], order: list[str], checkpoint: str) -> DataFrame:
    """Merge a stream of rows into a keyed table: the newest row of a key wins, whichever batch brings it.

    Late rows need no watermark, as the table itself is the state; the part of a
    row must follow from its key.
    """
    def each(batch: DataFrame, n: int) -> None:
        table.merge(newest(batch, keys, order), n, lambda held, new: newest(held.unionByName(new), keys, order))

    run_batches(source, each, checkpoint)
    return table.read()
