"""A streaming sink: each micro-batch is one commit, and a repeated batch is none.

The highest batch of each query is a table property that is committed with the
rows, so it outlives the expiry of snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.transaction import Transaction


def append_batch(location: str, query: str):
    """A ``foreachBatch`` function that appends to a table, once for each (query, batch id)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        from ..table import open_table

        table = open_table(batch.sparkSession, location)
        done = f"stream.batch.{query}"
        if int(table.properties.get(done, -1)) >= batch_id:
            return
        files = table.write_files(batch)
        if files:
            Transaction(table, "append", files, summary={"stream-batch": f"{query}:{batch_id}"}, properties={done: str(batch_id)}).commit()

    return run


def write_stream(stream: DataFrame, location: str, query: str, checkpoint: str, available_now: bool = True):
    """Starts a query that appends a stream to a table exactly once."""
    writer = stream.writeStream.queryName(query).foreachBatch(append_batch(location, query)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
