"""Structured Streaming forms of the batch jobs; late rows beyond the watermark are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigloom.sources.parsers import autodetect

WATERMARK = "10 minutes"


def ingest(lines: DataFrame, mode: str = "auto") -> DataFrame:
    """A stream of lines through the batch parsers."""
    return autodetect(lines, mode)


def dedup(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Each event_id once."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def burst(files: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Distinct changed files per (process, window), exact: each (process, path, window) is let through once, then counted.

    The state holds these rows until the watermark closes their window.
    """
    rows = files.withWatermark("ts", watermark).filter("mutating")
    once = rows.select(F.window("ts", window, slide).alias("window"), "process_name", "pid", "path").dropDuplicates(["window", "process_name", "pid", "path"])
    return once.groupBy("window", "process_name", "pid").agg(F.count("path").alias("unique_files"))


def _once(rows: DataFrame, watermark: str) -> DataFrame:
    """Each event once where rows have an event_id; late rows go here, one by one, so that they can be counted."""
    rows = rows.withWatermark("ts", watermark)
    return rows.dropDuplicatesWithinWatermark(["event_id"]) if "event_id" in rows.columns else rows


def bruteforce(failures: DataFrame, least: int = 5, window: str = "120 seconds", slide: str = "60 seconds", watermark: str = WATERMARK) -> DataFrame:
    rows = _once(failures, watermark)
    return rows.groupBy(F.window("ts", window, slide), "host", "src_ip").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def episodes(failures: DataFrame, gap: str = "120 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Attack episodes as session windows."""
    return _once(failures, watermark).groupBy(F.session_window("ts", gap), "host", "src_ip").agg(F.count("*").alias("n"))


def recon(hits: DataFrame, seconds: int = 300, watermark: str = WATERMARK) -> DataFrame:
    """Enumeration after identity of one process: the last identity time is the state, and times out.

    Rows of one trigger are taken in time order; order across triggers is that of arrival.
    """
    out = "host string, process_key string, event_id string, us bigint, identity_us bigint"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, found = (state.get[0] if state.exists else None), []
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        for us, event_id, kind in zip(rows["us"], rows["event_id"], rows["kind"], strict=True):
            if kind == "recon_identity":
                last = int(us)
            elif last is not None and 0 <= us - last < seconds * 1_000_000:
                found.append((key[0], key[1], event_id, int(us), last))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=["host", "process_key", "event_id", "us", "identity_us"])

    rows = hits.withWatermark("ts", watermark)
    return rows.groupBy("host", "process_key").applyInPandasWithState(step, out, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, then stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
