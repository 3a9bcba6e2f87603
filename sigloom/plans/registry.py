"""Queries over the driver's tables and their SQL oracles."""

from __future__ import annotations

from sigloom.operators import packs
from sigloom.plans import behaviour, detections, ingest

_PARTS = (behaviour, detections, ingest)
# columns whose type in the oracle is set to that of the query
_SCORED = (
    "sigma_match", "ps_detectors", "spawn_suspect", "auditd_detectors", "ai_network", "ai_integrity", "spawn_report", "recon_sequence", "signal_union", "signal_dedup",
    "top_signals", "by_tactic", "mitre_coverage", *(f"sigma_pack_{p}" for p in packs.PACKS),
)
_TYPES = {name: {"score": "DOUBLE"} for name in _SCORED} | {"lotl_cmdline": {"score": "DOUBLE", "confidence": "DOUBLE"}, "lotl_eventid": {"score": "DOUBLE", "confidence": "DOUBLE"}, "task_corroboration": {"confidence": "DOUBLE"}, "burst_sliding": {"max_unique": "BIGINT"}}


def _typed(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _TYPES.get(name, {}).items())
    return f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql


QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: _typed(name, s) for part in _PARTS for name, s in part.ORACLES.items()}
