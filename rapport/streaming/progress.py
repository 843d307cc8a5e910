"""Batch durations and row counts of a stream as rows of the archive."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from rapport.sinks.tables import Archive


class Progress(StreamingQueryListener):
    """Writes a row per batch of one stream, the one whose query name is ``name``, to the ``progress`` table.

    A batch that runs again overwrites its row. Rows arrive a moment after their batch, on Spark's listener thread; the
    listener takes itself off when its stream ends.
    """

    def __init__(self, archive: Archive, stream: str):
        self.archive, self.stream = archive, stream
        self.name = f"{stream}-{uuid.uuid4().hex[:8]}"
        self.run = None

    @classmethod
    def of(cls, archive: Archive, stream: str) -> Progress:
        """A listener that listens; give its ``name`` to the query."""
        listener = cls(archive, stream)
        archive.spark.streams.addListener(listener)
        return listener

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        batch = event.progress
        if batch.name != self.name or batch.numInputRows == 0:
            return
        steps = dict(batch.durationMs)
        row = (self.stream, str(batch.runId), batch.timestamp, batch.numInputRows, batch.batchDuration, steps,
               sum(state.numRowsTotal for state in batch.stateOperators))
        rows = self.archive.spark.createDataFrame([row], (
            "stream string, run_id string, started_at string, input_rows bigint, batch_ms bigint, "
            "steps map<string,bigint>, state_rows bigint"))
        self.archive.write("progress", rows.withColumn("started_at", F.to_timestamp("started_at")), batch.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.run is not None and event.runId == self.run:
            self.archive.spark.streams.removeListener(self)
