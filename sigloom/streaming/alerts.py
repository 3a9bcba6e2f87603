"""Alerts as state that ends: each alert is reported once, and its state goes when it can no longer come back.

State is kept by buckets of ids in RocksDB, restarts from the checkpoint, and is never read as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sigloom.streaming.jobs import WATERMARK

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "ids array<string>, first_us array<bigint>, last_us array<bigint>, n array<bigint>, changed_ms array<bigint>, timer bigint"
BUCKETS = 4096  # of ids


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB, and checkpoint what changed only."""
    spark.conf.set(_PROVIDER, _ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class AlertState(StatefulProcessor):
    """Per signal_id: first and last time and number of rows, kept together for the ids of a bucket.

    A call of the store costs far more than a row, so a bucket of ids is one value and has one timer, that of its id
    which ends first: calls grow with the buckets that a batch touches.  The first row of an id opens an alert and is
    passed on; `keep_ms` behind its last row it ends.  With ttl_ms (for processing time, where there are no event times)
    an id is forgotten so long after its last change, and the store drops a bucket so long after its own."""

    def __init__(self, columns: list[str], keep_ms: int, ttl_ms: int | None = None, ends: bool = False) -> None:
        self.columns, self.keep_ms, self.ttl_ms, self.ends = columns, keep_ms, ttl_ms, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", STATE, self.ttl_ms)

    def _read(self) -> tuple[dict[str, list], int | None]:
        """id -> [first_us, last_us, n, changed_ms], and the time of the timer that is set."""
        state = self.bucket.get() if self.bucket.exists() else None
        return ({r[0]: list(r[1:]) for r in zip(*state[:5], strict=True)}, state[5]) if state else ({}, None)

    def _write(self, alerts: dict[str, list], timer: int | None) -> None:
        if alerts:
            self.bucket.update((list(alerts), *map(list, zip(*alerts.values(), strict=True)), timer))
        else:
            self.bucket.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        alerts, timer = self._read()
        now = 0 if self.ttl_ms is None else timerValues.getCurrentProcessingTimeInMs()
        if self.ttl_ms is not None:
            alerts = {i: a for i, a in alerts.items() if a[3] + self.ttl_ms > now}
        opened: dict[str, Row] = {}
        for r in rows:
            i, us = r.signal_id, r.us
            alert = alerts.get(i)
            if alert is None:
                alerts[i], opened[i] = [us, us, 1, now], r
                continue
            if i in opened and us < opened[i].us:
                opened[i] = r
            alerts[i] = [min(alert[0], us), max(alert[1], us), alert[2] + 1, now]
        if self.ttl_ms is None:
            timer = self._timed(alerts, timer)
        self._write(alerts, timer)
        for i, r in opened.items():
            yield Row(signal_id=i, **{c: r[c] for c in self.columns}, status="open", first_us=r.us, last_us=r.us, n=1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        alerts, _ = self._read()
        watermark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = {i: a for i, a in alerts.items() if self._end(a[1]) <= watermark}
        alerts = {i: a for i, a in alerts.items() if i not in over}
        self._write(alerts, self._timed(alerts, None))
        if self.ends:
            for i, (first, last, n, _) in over.items():
                yield Row(signal_id=i, **dict.fromkeys(self.columns), status="ended", first_us=first, last_us=last, n=n)

    def close(self) -> None:
        pass

    def _timed(self, alerts: dict[str, list], timer: int | None) -> int | None:
        """Sets the timer where the first end is before it; one that is too early is set anew when it fires."""
        first = min((self._end(a[1]) for a in alerts.values()), default=None)
        if first is None or timer is not None and timer <= first:
            return timer
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(first)
        return first

    def _end(self, us: int) -> int:
        return us // 1000 + self.keep_ms


def alert_states(signals: DataFrame, keep: str = WATERMARK, watermark: str = WATERMARK, ends: bool = False, ttl: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Streamed signals (signal_id, us, ...) as alerts: columns of the first row, status, first_us, last_us, n.

    Each signal_id comes out once as `open`, however often and in whatever batch it is repeated; with `ends` it comes
    out as `ended`, with its times and count, when the watermark is `keep` beyond its last row.  A row that is
    repeated after that is older than the watermark and dropped as late, so no alert is reported twice although its
    state is gone.  ttl: state lives so long in processing time instead, and there is no watermark; such a stream
    never ends by itself, so give it a processing-time trigger.

    Ids are dealt to `buckets` by hash; a batch reads and writes the buckets it touches, each with its live ids.  A
    checkpoint stays with the number of buckets it was made with.

    The session's state store becomes RocksDB.  Rows without signal_id or us are left out."""
    use_rocksdb(signals.sparkSession)
    milliseconds = lambda text: signals.sparkSession.range(1).select(F.expr(f"CAST(unix_millis(timestamp_seconds(0) + INTERVAL {text}) AS BIGINT)")).first()[0]
    rows = signals.filter("signal_id IS NOT NULL AND us IS NOT NULL")
    columns = [c for c in rows.columns if c not in ("signal_id", "us")]
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("signal_id"), F.lit(buckets)))
    schema = ", ".join(["signal_id string", *[f"`{c}` {dict(rows.dtypes)[c]}" for c in columns], "status string", "first_us long", "last_us long", "n long"])
    if ttl is None:
        rows = rows.withColumn("event_time", F.timestamp_micros("us")).withWatermark("event_time", watermark)
    processor = AlertState(columns, milliseconds(keep), milliseconds(ttl) if ttl else None, ends)
    return rows.groupBy("__bucket").transformWithState(processor, schema, "Append", "ProcessingTime" if ttl else "EventTime")
