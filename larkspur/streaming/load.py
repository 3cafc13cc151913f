"""A stream as a source of an engine table: each micro-batch is one checked, atomic append or upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from larkspur.session import Engine


def load_stream(engine: Engine, stream: DataFrame, table: str, checkpoint: str, upsert: bool = False, available_now: bool = True) -> StreamingQuery:
    """Starts a query that writes stream to table. Upserts make a batch that runs twice after a failure harmless; appends
    to a table with a primary key refuse it."""

    def write(batch: DataFrame, _: int) -> None:
        engine.append(table, batch, upsert=upsert)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
