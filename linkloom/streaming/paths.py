"""Answer a stream of path queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators.search import shortest_paths


def answer_stream(queries: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the answers to each batch of (query_id, start, target) to a Parquet table, partitioned by batch.

    A batch that is tried again replaces its own partition.
    """

    def each(batch: DataFrame, number: int) -> None:
        shortest_paths(nodes, edges, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
