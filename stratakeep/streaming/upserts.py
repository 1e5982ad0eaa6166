"""Streams into tables: every micro-batch is one commit, and a replayed one changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def upsert_stream(engine: Engine, table: str, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert a stream of rows (the table's columns, by name) into a table.

    A batch that is run again after a failure upserts rows that are there already, which is no
    change.  Of several rows of one key in a batch the least counts; order them before if it
    matters.  ``trigger`` goes to the writer, as in ``availableNow=True``.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: engine.upsert_df(table, rows))
    return (writer.trigger(**trigger) if trigger else writer).start()
