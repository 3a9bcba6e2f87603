"""Many needles in one pass: an Aho-Corasick automaton over Arrow bytes.

The rule packs of the library compile to column expressions (rules.sigma_all), whose cost grows
with the number of needles.  For rule sets of hundreds or thousands of needles the automaton
here reads each byte once, whatever their number: all texts of a batch advance side by side, a
byte a step, through one table.  Long texts are cut into pieces that overlap by the longest
needle, so a batch takes PIECE steps at most.

The table is sent to the tasks; it grows with the rules (states x different bytes x 4), not
with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 4096

Packs = dict[str, dict[str, tuple[str, ...]]]


class Automaton:
    """Goto table over the byte classes of the needles, and the needles that end in each state."""

    def __init__(self, needles: list[bytes]) -> None:
        self.longest = max(map(len, needles), default=0)
        used = sorted(set(b"".join(needles)))
        self.classes = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1  # class 0: bytes of no needle
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for i, needle in enumerate(needles):
            state = 0
            for c in self.classes[np.frombuffer(needle, np.uint8)].tolist():
                if c not in children[state]:
                    children[state][c] = len(children)
                    children.append({})
                    ends.append([])
                state = children[state][c]
            ends[state].append(i)
        self.goto = np.zeros((len(children), width), np.int32)
        fail = [0] * len(children)
        level = [0]
        while level:  # by depth: a state's row is its failure state's, but for its own children
            below = []
            for state in level:
                row = self.goto[fail[state]].copy() if state else self.goto[0]
                for c, child in children[state].items():
                    fail[child] = int(row[c]) if state else 0
                    row[c] = child
                self.goto[state] = row
                below += children[state].values()
            for child in below:
                ends[child] += ends[fail[child]]
            level = below
        self.heads = np.cumsum([0] + [len(e) for e in ends])
        self.needles = np.array([i for e in ends for i in e], np.int64)
        self.final = np.diff(self.heads) > 0
        self.empty = [i for i, n in enumerate(needles) if not n]

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, needle) of every needle that a text holds, each pair once, sorted."""
        many = max(1, len(self.heads))
        size = np.diff(offsets)
        pieces = np.maximum(1, -(-size // PIECE))
        text = np.repeat(np.arange(len(size)), pieces)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        length = np.minimum(size[text] - at, PIECE + max(0, self.longest - 1))
        order = np.argsort(-length, kind="stable")
        start, length, text = (offsets[text] + at)[order], length[order], text[order]
        state, hits = np.zeros(len(text), np.int32), [np.zeros(0, np.int64)]
        live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")  # pieces of so many bytes
        for step, n in enumerate(live.tolist()):
            state[:n] = self.goto[state[:n], self.classes[data[start[:n] + step]]]
            some = np.flatnonzero(self.final[state[:n]])
            if len(some):
                hits.append(text[some] * many + state[some])
        found = np.unique(np.concatenate(hits))
        text, at_state = found // many, found % many
        ends = self.heads[at_state + 1] - self.heads[at_state]
        needle = self.needles[np.repeat(self.heads[at_state], ends) + np.arange(ends.sum()) - np.repeat(np.cumsum(ends) - ends, ends)]
        text = np.concatenate((np.repeat(text, ends), *[np.arange(len(size))] * len(self.empty)))
        needle = np.concatenate((needle, *[np.full(len(size), i) for i in self.empty]))
        pair = np.unique(text * (len(self.needles) + len(self.empty) + 1) + needle)
        return pair // (len(self.needles) + len(self.empty) + 1), pair % (len(self.needles) + len(self.empty) + 1)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offsets


def sigma_many(events: DataFrame, packs: Packs, lower: bool = False) -> DataFrame:
    """(event_id, host, pack, selections, score) as rules.sigma_all() gives, for packs of any number of needles.

    Needles that are patterns (`re:`) stay column expressions.  A null text holds no needle."""
    field = F.coalesce("script_block", "command_line") if "script_block" in events.columns else F.col("command_line")
    field = F.lower(field) if lower else field
    selections = [(p, s) for p, own in packs.items() for s in own]
    owners: dict[bytes, set[int]] = {}
    patterns = []
    for i, (p, s) in enumerate(selections):
        for n in packs[p][s]:
            if n.startswith("re:"):
                patterns.append(F.when(field.rlike(n[3:]), i))
            else:
                owners.setdefault((n.lower() if lower else n).encode(), set()).add(i)
    needles = sorted(owners)
    of = [sorted(owners[n]) for n in needles]
    sent = events.sparkSession.sparkContext.broadcast((Automaton(needles), of, selections))
    also = F.array_compact(F.array(*patterns)) if patterns else F.array().cast("array<int>")
    schema = pa.schema([("event_id", pa.string()), ("host", pa.string()), ("pack", pa.string()), ("selections", pa.list_(pa.string())), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, of, selections = sent.value
        for batch in batches:
            text, needle = automaton.find(*_bytes(batch.column("field")))
            hit: dict[int, set[int]] = {}
            for t, n in zip(text.tolist(), needle.tolist(), strict=True):
                hit.setdefault(t, set()).update(of[n])
            given = batch.column("field").is_valid().to_numpy(zero_copy_only=False)
            also = batch.column("also")
            for t in np.flatnonzero(pc.list_value_length(also).to_numpy() > 0).tolist():
                hit.setdefault(t, set()).update(also[t].as_py())
            ids, hosts = batch.column("event_id"), batch.column("host")
            out = []
            for t in sorted(t for t in hit if given[t]):
                by_pack: dict[str, list[str]] = {}
                for i in sorted(hit[t]):
                    by_pack.setdefault(selections[i][0], []).append(selections[i][1])
                out += [{"event_id": ids[t].as_py(), "host": hosts[t].as_py(), "pack": p, "selections": s, "score": round(min(1.0, 0.6 + 0.1 * len(s)), 6)} for p, s in by_pack.items()]
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = events.select(F.col("event_id").cast("string").alias("event_id"), F.col("host").cast("string").alias("host"), field.alias("field"), also.alias("also"))
    return rows.mapInArrow(run, "event_id string, host string, pack string, selections array<string>, score double")
