"""Runs of signal layers: one pass that writes the signals, counts as it goes, and survives a layer that fails.

Counts come from metrics observed on that pass.  A layer that fails on a row while running (not
only one that cannot be planned) is found by trying each layer alone, left out, and reported; the
others' signals are written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Layers = list[tuple[str, Callable[[], Column]]]
COLUMNS = ("signal_type", "score", "tactic", "technique")
SIGNALS = "array<struct<signal_type:string,score:double,tactic:string,technique:string,layer:string>>"
HEALTH = "layer string, status string, signals long, error string"


@dataclass
class Run:
    """signals: the stored signals; events: how many were read; health: a row for each layer."""

    signals: DataFrame
    events: int
    health: DataFrame


def layer_hits(events: DataFrame, layers: Layers) -> tuple[dict[str, Column], dict[str, str]]:
    """(hits of each layer that can be planned, errors of the others)."""
    fine, failed = {}, {}
    for name, make in layers:
        try:
            layer = F.lit(name).alias("layer")
            hits = F.transform(make(), lambda h: F.struct(*[h[c].alias(c) for c in COLUMNS], layer))  # noqa: B023  called here
            events.select(hits)
        except Exception as error:  # noqa: BLE001  a layer's failure is reported, not raised
            failed[name] = _said(error)
            continue
        fine[name] = hits
    return fine, failed


def _said(error: Exception) -> str:
    """An error's own words, without the trace."""
    lines = [x for x in str(error).splitlines() if x.strip()]
    return next((x for x in lines if "[" in x and "SQLSTATE" in x), lines[0] if lines else type(error).__name__)[:500]


def _write(events: DataFrame, hits: dict[str, Column], path: str) -> dict:
    """Write the signals of one pass; its metrics."""
    made = events.select("event_id", "host", *[h.cast(SIGNALS).alias(f"of_{i}") for i, h in enumerate(hits.values())])
    seen = Observation()
    each = [F.coalesce(F.sum(F.size(f"of_{i}")), F.lit(0)).alias(name) for i, name in enumerate(hits)]
    made = made.observe(seen, F.count(F.lit(1)).alias("__events"), *each)
    everything = F.concat(*[F.col(f"of_{i}") for i in range(len(hits))]) if hits else F.array().cast(SIGNALS)
    made.select("event_id", "host", F.explode(everything).alias("s")).select("event_id", "host", "s.*").write.mode("overwrite").parquet(path)
    return seen.get


def _alone(events: DataFrame, hits: Column) -> str | None:
    """Why a layer fails by itself, or None."""
    try:
        events.select(hits.alias("hits")).write.format("noop").mode("overwrite").save()
    except Exception as error:  # noqa: BLE001
        return _said(error)
    return None


def run_layers(events: DataFrame, layers: Layers, path: str) -> Run:
    """Write (event_id, host, signal_type, score, tactic, technique, layer) of all sound layers to a folder, in one pass.

    What fails with every layer alone fine is no layer's fault, and is raised."""
    spark = events.sparkSession
    hits, failed = layer_hits(events, layers)
    while True:
        try:
            counts = _write(events, hits, path)
            break
        except Exception:
            broken = {name: said for name, h in hits.items() if (said := _alone(events, h))}
            if not broken:
                raise
            failed |= broken
            hits = {name: h for name, h in hits.items() if name not in broken}
    rows = [(name, "failed", None, failed[name]) if name in failed else (name, "ok", counts[name], None) for name, _ in layers]
    return Run(spark.read.parquet(path), counts["__events"], spark.createDataFrame(rows, HEALTH))
