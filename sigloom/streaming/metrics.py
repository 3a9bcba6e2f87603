"""What streams do, as a table: rows in, rows dropped as late, size of state, batch by batch."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, run string, batch long, at string, rows_in long, late_rows long, state_rows long, state_bytes long, watermark string, seconds double"


class ProgressTable(StreamingQueryListener):
    """Listener that appends a row for each batch of every stream of the session to a table of JSON lines.

    late_rows counts what stateful operators dropped because the watermark had passed it.  Operators that take rows one
    by one (deduplication, keyed state) count rows; a windowed aggregation counts its partial groups, so put
    deduplication before it where rows are to be counted (jobs.bruteforce and jobs.episodes do).

    The listener only notes rows; a thread of its own writes them, `seconds` after the last time at the latest, as
    jobs must not be run from within the listeners' thread.  close() writes the rest."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 60) -> None:
        self.spark, self.path, self.seconds = spark, path, seconds
        self.rows: list[tuple] = []
        self.lock, self.done = threading.Lock(), threading.Event()
        self.writer = threading.Thread(target=self._write, daemon=True)
        self.writer.start()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        states = p.stateOperators
        total = lambda name: sum(getattr(s, name) for s in states)
        row = (p.name or str(p.id), str(p.runId), p.batchId, p.timestamp, p.numInputRows, total("numRowsDroppedByWatermark"), total("numRowsTotal"), total("memoryUsedBytes"), p.eventTime.get("watermark"), p.batchDuration / 1000)
        with self.lock:
            self.rows.append(row)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass

    def _write(self) -> None:
        while not self.done.wait(self.seconds):
            self.flush()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def close(self) -> None:
        """Stop listening and write what is noted."""
        self.spark.streams.removeListener(self)
        self.done.set()
        self.writer.join()
        self.flush()

    def table(self) -> DataFrame:
        """All rows written so far."""
        return self.spark.read.schema(SCHEMA).json(self.path)


def watch(spark: SparkSession, path: str, seconds: float = 60) -> ProgressTable:
    """Write the progress of the session's streams to a table from now on."""
    table = ProgressTable(spark, path, seconds)
    spark.streams.addListener(table)
    return table
