"""Continuous loading: each micro-batch of parsed rows is upserted into the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ripplet.operators.load import load_graph
from ripplet.plans.schemas import EDGES, VERTICES


def stream_vertices(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(VERTICES).parquet(folder)


def stream_load(spark: SparkSession, vertices: DataFrame, graph_path: str, checkpoint: str, edges_of: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Load every batch once available; the latest batch of a vertex wins. A batch that is replayed after a failure gives the same graph."""

    def load(batch: DataFrame, _: int) -> None:
        edges = edges_of(batch) if edges_of else batch.sparkSession.createDataFrame([], EDGES)
        load_graph(batch.sparkSession, batch, edges, graph_path)

    return vertices.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
