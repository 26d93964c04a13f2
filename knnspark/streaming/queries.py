"""Streams of queries against a fixed base or index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.exact import brute_force
from ..operators.index import VectorIndex


def stream_queries(queries: DataFrame, target: VectorIndex | DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 10, trigger: dict | None = None, **options) -> StreamingQuery:
    """Answers each micro-batch of a streaming DataFrame (vec_id, embedding) and hands the results to sink(df, batch_id).

    target: an index (approximate) or a base DataFrame (exact). A batch can come again after a failure: a sink should
    overwrite by batch_id.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        found = target.query(batch, k_query=k, **options) if isinstance(target, VectorIndex) else brute_force(target, batch, k, **options)
        sink(found, batch_id)

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
