"""Streams into a graph: micro-batches of nodes or edges are appended to Parquet tables that the graph reads.

Writing each batch under its batch id makes a batch that is run again replace itself, so that every row counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import Catalog, EdgeTable


def _start(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_nodes(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Takes in rows with ``_id`` and properties (and ``_vec``)."""
    return _start(stream, folder, checkpoint)


def stream_edges(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Takes in rows with ``_eid, _src, _dst`` and properties."""
    return _start(stream, folder, checkpoint)


def with_streamed(catalog: Catalog, spark: SparkSession, nodes: dict[tuple[str, ...], str] | None = None, edges: dict[str, str] | None = None) -> Catalog:
    """The graph with what has arrived so far in the folders of labels and of edge types."""
    for labels, folder in (nodes or {}).items():
        catalog = catalog.with_nodes(labels, spark.read.parquet(folder).drop("batch"))
    return catalog.with_edges(*[EdgeTable(kind, spark.read.parquet(folder).drop("batch")) for kind, folder in (edges or {}).items()])
