"""Alert state over many batches and restarts, and the counts of late rows."""

from __future__ import annotations

import os
import shutil
import time
from pathlib import Path

from pyspark.sql import functions as F

from sigloom.streaming import jobs, metrics
from sigloom.streaming.alerts import alert_states

S = 1_000_000
EPOCH = 1_700_000_000 * S
SCHEMA = "signal_id string, us long, score double"


def _batch(spark, folder, rows):
    """One file more, later than the files before it."""
    before = len(list(Path(folder).glob("*.parquet"))) if os.path.isdir(folder) else 0
    staging = f"{folder}-staging{before}"
    rows = [(i, us and us + EPOCH, score) for i, us, score in rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(staging)
    os.makedirs(folder, exist_ok=True)
    made = f"{folder}/{before:04d}.parquet"
    shutil.move(str(next(Path(staging).glob("*.parquet"))), made)
    os.utime(made, (1_700_000_000 + before, 1_700_000_000 + before))


def _run(spark, base, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = alert_states(stream, "30 seconds", "10 seconds", **options)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{base}/out")
    return found, query.recentProgress


def test_alert_state_ends_and_survives_restarts(spark, tmp_path):
    base = str(tmp_path)
    batches = 12
    for i in range(batches):  # five new signals a minute, each repeated in the next batch and within its own
        now = [(f"s{i}-{j}", 60 * i * S + j + 1, 0.5) for j in range(5)]
        again = [(f"s{i - 1}-0", 60 * i * S, 0.9)] if i else []
        _batch(spark, f"{base}/in", [*now, now[0], *again])
    found, progress = _run(spark, base, ends=True)
    opened = found.filter("status = 'open'").collect()
    assert sorted(r["signal_id"] for r in opened) == sorted({f"s{i}-{j}" for i in range(batches) for j in range(5)})
    assert all(r["score"] == 0.5 for r in opened)
    ended = {r["signal_id"]: (r["first_us"] - EPOCH, r["last_us"] - EPOCH, r["n"]) for r in found.filter("status = 'ended'").collect()}
    assert ended["s0-1"] == (2, 2, 1)
    assert ended["s2-3"] == (120 * S + 4, 120 * S + 4, 1)
    state = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(state[2:]) <= 3 * state[1] + 10  # timers count, too; it does not grow with the batches
    assert max(state[-4:]) <= max(state[2:6])

    # all rows once more, after a restart: nothing is reported again
    for i in range(0, batches, 4):
        _batch(spark, f"{base}/in", [(f"s{i}-{j}", 60 * i * S + j + 1, 0.5) for j in range(5)])
    again, progress = _run(spark, base, ends=True)
    assert sorted(r["signal_id"] for r in again.filter("status = 'open'").collect()) == sorted(r["signal_id"] for r in opened)
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 15

    # a batch whose end was not noted is run again and changes nothing
    rows = again.count()
    last = max(int(p.name) for p in Path(f"{base}/checkpoint/commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        Path(f"{base}/checkpoint/commits/{name}").unlink(missing_ok=True)
    assert _run(spark, base, ends=True)[0].count() == rows


def test_ids_of_a_bucket_share_its_state_and_timer(spark, tmp_path):
    """State has a row for a bucket, not for an id; each id opens once, and ends by its own last row."""
    base = str(tmp_path)
    _batch(spark, f"{base}/in", [(f"a{i}", i * S, 0.5) for i in range(1, 61) for _ in range(2)])
    _batch(spark, f"{base}/in", [("a3", 61 * S, 0.9), ("a60", 62 * S, 0.9), ("a60", 61 * S, 0.8)])
    _batch(spark, f"{base}/in", [("a3", 75 * S, 0.9), ("b", 76 * S, 0.1)])
    _batch(spark, f"{base}/in", [("c", 1000 * S, 0.1)])
    found, progress = _run(spark, base, ends=True, buckets=4)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 4
    opened = found.filter("status = 'open'").collect()
    assert sorted(r["signal_id"] for r in opened) == sorted(["b", "c", *[f"a{i}" for i in range(1, 61)]])
    assert {r["score"] for r in opened if r["signal_id"].startswith("a")} == {0.5}
    ended = {r["signal_id"]: ((r["first_us"] - EPOCH) // S, (r["last_us"] - EPOCH) // S, r["n"]) for r in found.filter("status = 'ended'").collect()}
    assert ended == {**{f"a{i}": (i, i, 2) for i in range(1, 61)}, "a3": (3, 75, 4), "a60": (60, 62, 4), "b": (76, 76, 1)}


def test_alert_state_with_ttl(spark, tmp_path):
    base = str(tmp_path)
    _batch(spark, f"{base}/in", [("a", 1, 0.5), ("a", 2, 0.6), (None, 3, 0.1), ("b", None, 0.1)])
    _batch(spark, f"{base}/in", [("a", 1, 0.5)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = alert_states(stream, ttl="1 hour")
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime="1 second").start(f"{base}/out")
    for _ in range(240):
        if sum(p["numInputRows"] for p in query.recentProgress) >= 5:
            break
        time.sleep(0.25)
    query.stop()
    found = spark.read.schema(out.schema).parquet(f"{base}/out")
    assert [(r["signal_id"], r["status"], r["score"]) for r in found.collect()] == [("a", "open", 0.5)]


def test_late_rows_are_counted(spark, tmp_path):
    base = str(tmp_path)
    table = metrics.watch(spark, f"{base}/progress")
    try:
        _batch(spark, f"{base}/in", [(f"e{i}", i * S + 1, 0.0) for i in range(100)])
        _batch(spark, f"{base}/in", [("new", 5000 * S, 0.0)])
        _batch(spark, f"{base}/in", [(f"late{i}", i * S + 1, 0.0) for i in range(37)] + [("fine", 5001 * S, 0.0)])
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        rows = rows.select(F.timestamp_micros("us").alias("ts"), F.lit("h").alias("host"), F.lit("ip").alias("src_ip"), F.col("signal_id").alias("event_id"))
        jobs.run_once(jobs.bruteforce(rows, 5, "120 seconds", "60 seconds", "10 seconds"), f"{base}/out", f"{base}/checkpoint")
        for _ in range(100):  # progress reaches listeners a little later
            if sum(r[4] for r in table.rows) >= 139:
                break
            time.sleep(0.1)
    finally:
        table.close()
    found = table.table()
    assert found.agg(F.sum("late_rows")).first()[0] == 37
    assert found.agg(F.sum("rows_in")).first()[0] == 139
    assert found.filter("state_rows > 0").count() > 0
