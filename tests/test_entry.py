"""Driver contract: names agree, the flagship runs, sources reject what they must."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sigloom.plans import ingest, registry
from sigloom.sources import parsers


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(registry.QUERIES) >= 95


def test_entry_without_the_training_data_folder(tmp_path):
    """With its folder and script removed the rest still registers; with an error inside it nothing is hidden."""
    home = Path(__spark_entry__.__file__).parent
    shutil.copytree(home / "sigloom", tmp_path / "sigloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    count = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = lambda: subprocess.run([sys.executable, "-c", count], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert run().stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLES))]
    (tmp_path / "sigloom/llm").mkdir()
    (tmp_path / "sigloom/llm/__init__.py").write_text("")
    (tmp_path / "sigloom/llm/registry.py").write_text("import no_such_module_anywhere\n")
    assert "no_such_module_anywhere" in run().stderr


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_unknown_profile_raises(spark):
    with pytest.raises(ValueError, match="unknown profile"):
        parsers.profile_gate(spark.createDataFrame([("json",)], "source string"), "nothing")


def test_malformed_lines_are_kept_aside(spark):
    df = spark.createDataFrame([("{bad",), ("",), ('{"timestamp": "2024-01-01T00:00:00", "pid": 4}',), ("<34>1 x",)], "value string")
    assert [r["malformed"] for r in parsers.jsonl(df).orderBy("raw").collect()].count(True) == 2
    got = parsers.autodetect(df)
    assert got.count() == 3
    assert got.filter(~F.col("accepted")).count() == 3


def test_stream_recon_equals_batch(spark):
    from sigloom.plans import detections

    sf = "/root/testdata/sf0.001"
    batch = {(r["event_id"], r["identity_us"]) for r in detections.recon_sequence(spark, sf).collect()}
    stream = {(r["event_id"], r["identity_us"]) for r in ingest.stream_recon(spark, sf).collect()}
    assert stream == batch


def test_stream_burst_counts_exactly(spark, tmp_path):
    from sigloom.streaming import jobs

    rows = [("p", k, f"f{k}-{i}", 60 * k + i % 50) for k in range(40) for i in range(150 + k)]
    df = spark.createDataFrame(rows, "process_name string, pid int, path string, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("mutating", F.lit(True)).drop("s")
    late = df.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(10_000)))
    df.union(df).union(late).write.parquet(f"{tmp_path}/in")
    stream = jobs.burst(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "60 seconds", "30 seconds")
    jobs.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    found = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    got = {(r["s"], r["pid"]): r["unique_files"] for r in found.select(F.unix_seconds("window.start").alias("s"), "pid", "unique_files").collect()}
    want = df.select("pid", "path", F.window("ts", "60 seconds", "30 seconds").alias("w")).groupBy(F.unix_seconds("w.start").alias("s"), "pid").agg(F.countDistinct("path").alias("n"))
    assert got == {(r["s"], r["pid"]): r["n"] for r in want.collect()}
