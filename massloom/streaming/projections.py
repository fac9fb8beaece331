"""Projection operators on streams: what needs no state runs unchanged on a streaming frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Step = Callable[[DataFrame], DataFrame]


def run_projection(stream: DataFrame, step: Step, path: str, checkpoint: str) -> StreamingQuery:
    """Apply ``step`` (list expansion, string functions, modification extraction) to a stream and append Parquet under ``path``.

    All input that is there is processed in micro-batches, then the query ends; exactly once by the checkpoint.
    """
    return step(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
