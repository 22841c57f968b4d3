"""Extension: keep the projected graph up to date from a stream of dependency edges.

Each micro-batch of edges is reduced to resolved relationships and written under its
batch number, so a batch that is run again replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.project import EDGE_KEY, derived
from ..schemas import GRAPH_EDGES


def project_stream(edges: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer to start: streamed dependency edges to batches of relationships below folder."""

    def write(batch: DataFrame, number: int) -> None:
        rows = derived(batch).dropDuplicates(EDGE_KEY)
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def projected(spark, folder: str) -> DataFrame:
    """All relationships so far, once each."""
    rows = spark.read.schema(GRAPH_EDGES).option("basePath", folder).parquet(f"{folder}/batch=*")
    return rows.dropDuplicates(EDGE_KEY).select(*[F.col(f.name) for f in GRAPH_EDGES])
