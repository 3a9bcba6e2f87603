"""Artifacts of a run as JSON lines, and the one-file report for small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_artifacts(path: str, events: DataFrame, signals: DataFrame, alerts: DataFrame, timelines: DataFrame, buckets: int = 16) -> None:
    """Events, signals, alerts; timelines are partitioned by alert bucket, not one file an alert."""
    for name, df in (("normalized_events", events), ("signals", signals), ("alerts", alerts)):
        df.write.mode("overwrite").json(f"{path}/{name}")
    bucket = F.pmod(F.xxhash64("alert_id"), F.lit(buckets))
    rows = timelines.withColumn("alert_bucket", bucket).repartition("alert_bucket").sortWithinPartitions("alert_id", "place")
    rows.write.mode("overwrite").partitionBy("alert_bucket").json(f"{path}/timelines")


def report(processes: DataFrame, **parameters: object) -> DataFrame:
    """Process rows as JSON with the run's parameters; rows stay distributed."""
    return processes.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(parameters.items())], F.struct(*processes.columns).alias("process"))).alias("value"))


def document(processes: DataFrame, most: int = 10_000, **parameters: object) -> DataFrame:
    """One JSON document of the run's parameters and all processes, for small results: more than
    `most` rows are an error, as one document is one row's value.  No more than that are gathered."""
    rows = F.sort_array(F.collect_list(F.struct(*processes.columns)))
    checked = F.when(F.count("*") > most, F.raise_error(F.lit(f"more than {most} processes are too many for one document"))).otherwise(rows)
    made = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(parameters.items())], F.col("suspicious_processes")))
    return processes.limit(most + 1).agg(checked.alias("suspicious_processes")).select(made.alias("value"))
