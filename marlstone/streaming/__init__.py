"""Streams through the same statements.

A stream is registered like a table; a SELECT over it without sorting, limit or grouping is
a stream again, and can be inserted into a table batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import BindError, PlanError
from ..functions.types import assignable, fields_of
from ..operators.changes import finished
from ..session import Session


def insert_stream(session: Session, rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append a streaming DataFrame that has the table's columns, one table version for each batch.

    Columns are matched by name, without regard to case; a missing one, and a type that INSERT
    would not take either, are refused before the stream starts.  The table's version says which
    batch of the checkpoint was the last one in it, so a batch that comes again, in this query or
    in one started anew, is not added twice.
    """
    target, given = session.catalog.get(table), {f.name.lower(): f for f in fields_of(rows.schema)}
    for f in target.fields:
        if f.name.lower() not in given:
            raise BindError("ColumnNotFound", f.name)
        if not assignable(given[f.name.lower()].type, f.type):
            raise PlanError("InsertSchemaMismatch", f"{f.name} {f.type} from {given[f.name.lower()].type}")

    def add(batch: DataFrame, number: int) -> None:
        if number <= target.batches.get(checkpoint, -1):
            return
        part = session.catalog.write(finished(batch, target, {f.name: F.col(f"`{f.name}`") for f in target.fields}), target)
        with session._lock:
            if part._rows:
                session.catalog.add(target, part)
            target.batches[checkpoint] = number

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
