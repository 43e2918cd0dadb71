"""Continuous intake: a stream of query texts answered as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftgraph.graph import Graph
from weftgraph.plans.compile import query

EXIT = "server_exit"


def answer_stream(graph: Graph, folder: str, sink: Callable[[str, DataFrame], None], checkpoint: str, available_now: bool = False, **options: Any) -> StreamingQuery:
    """Answer each file of ``folder`` (one query text) and hand name and rows to ``sink``; a broken one gets its error.

    A file whose text is ``server_exit`` ends the stream.  Files seen before are remembered in ``checkpoint``.
    """
    spark = graph.spark
    texts = spark.readStream.schema("value string").option("wholetext", "true").text(folder).selectExpr("_metadata.file_name as name", "value")
    stop: list[bool] = []

    def each(batch: DataFrame, _: int) -> None:
        # a micro-batch holds query texts, not data
        for row in batch.orderBy("name").toLocalIterator():
            if row.value.strip() == EXIT:
                stop.append(True)
                continue
            try:
                sink(row.name, query(graph, row.value, **options))
            except ValueError as e:
                sink(row.name, spark.createDataFrame([(str(e),)], "error string"))

    writer = texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    running = (writer.trigger(availableNow=True) if available_now else writer).start()
    running.exit_seen = stop
    return running


def serve(running: StreamingQuery, poll: float = 1.0) -> None:
    """Wait until an exit file was seen, then stop."""
    while running.isActive and not running.exit_seen:
        running.awaitTermination(poll)
    running.stop()
