"""A stream of mutations into a graph: each micro-batch is one write.

The stream's rows are the parameters of a write statement (``UNWIND $rows AS r
MERGE …``); batches are applied in order, and every batch leaves a new snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..operators.writes import consolidated


def apply(engine: Engine, rows: DataFrame, statement: str, checkpoint: str, compact_every: int = 10, once: bool = False) -> StreamingQuery:
    """Start applying ``rows`` (a streaming DataFrame) to the engine's graph.
    A batch that is tried again gives the same snapshot, as writes are upserts
    by key. Every few batches the graph is written out, which cuts its lineage."""

    def batch(df: DataFrame, number: int) -> None:
        if df.isEmpty():
            return
        engine.write(statement, {"rows": df})
        if number % compact_every == compact_every - 1:
            engine.graph = consolidated(engine.graph)

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
