r"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered once, with the character span of every turn's text.
The rendering is encoded once, with offsets, and token spans are intersected with the
sorted turn spans by binary search, which gives the loss mask over tokens.

Template: `<s>[INST] text [/INST]` for a user turn, `<s>[OUT] text </s>` for an assistant
turn, `<s>[ROLE] role [SEP] text [/ROLE]` for any other.  Inside texts and roles, `\`
becomes `\\`, and `[` and `<` get a `\` behind them, so no control string survives and
the rendering can be read back exactly.

Token spans tile the rendering: a token reaches to the start of the next one, so that
characters which the tokenizer trims from its offsets belong to a token too.

Defined cases: null text and null role are empty; a null turn comes first; turns that
share a number go by role and text; repeated rows are turns of their own; a null conv_id
is a conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
LOSS_ROLE = "assistant"

# The template's control strings
START = "<s>"
ROLES = {"user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")}
OTHER, SEPARATOR, OTHER_END = "[ROLE] ", " [SEP] ", " [/ROLE]"

_ESCAPED = {"\\": "\\\\", "[": "[\\", "<": "<\\"}
_ESCAPE = re.compile(r"[\\\[<]")
_UNESCAPE = re.compile(r"\\\\|\[\\|<\\")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering of (role, text) turns and the span of each escaped text."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, tail = ROLES.get(role) or (OTHER + escape(role) + SEPARATOR, OTHER_END)
        body = escape(text)
        at += len(START) + len(head)
        spans.append((at, at + len(body)))
        at += len(body) + len(tail)
        out += (START, head, body, tail)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendering.  START begins a turn and nothing else: texts cannot hold it."""
    turns = []
    for piece in formatted.split(START)[1:]:
        for role, (head, tail) in ROLES.items():
            if piece.startswith(head) and piece.endswith(tail):
                turns.append((role, unescape(piece[len(head) : -len(tail)])))
                break
        else:
            role, _, text = piece[len(OTHER) : -len(OTHER_END)].partition(SEPARATOR)
            turns.append((unescape(role), unescape(text)))
    return turns


def masked_spans(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]], wanted: list[bool]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Loss mask over tokens, and for each wanted span the character ranges its tokens cover.

    starts, ends: sorted token spans; spans: sorted, disjoint turn spans.
    """
    mask, covered = np.zeros(len(starts), bool), []
    for (a, b), want in zip(spans, wanted, strict=True):
        if not want:
            continue
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        ranges = [(max(a, int(s)), min(b, int(e))) for s, e in zip(starts[i:j], ends[i:j], strict=True) if min(b, e) > max(a, s)]
        mask[i:j] |= (np.minimum(ends[i:j], b) > np.maximum(starts[i:j], a))
        covered.append(ranges)
    return mask, covered


SCHEMA = "conv_id long, n_turns long, formatted string, token_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:long,end:long>>"


def format_conversations(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation: rendering, tokens, token mask, and the loss character spans.

    loss_spans are what the masked tokens cover of each assistant text, in order (adjacent
    ranges joined; an empty text has none).  A conversation is the unit of a rendering, so
    its turns meet in one row.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # array_sort puts the null turn number first within structs
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                turns = [[(t["role"], t["text"]) for t in x] for x in part.column("turns").to_pylist()]
                rendered = [render(t) for t in turns]
                ids, masks, loss = [], [], []
                for (text, spans), t, e in zip(rendered, turns, tokenizer.encode_batch([r[0] for r in rendered], add_special_tokens=False), strict=True):
                    starts = np.array([o[0] for o in e.offsets], np.int64)
                    if len(starts):
                        starts[0] = 0
                    starts = np.maximum.accumulate(starts) if len(starts) else starts
                    ends = np.append(starts[1:], len(text)) if len(starts) else starts
                    mask, covered = masked_spans(starts, ends, spans, [role == LOSS_ROLE for role, _ in t])
                    joined: list[dict] = []
                    for ranges in covered:
                        own: list[dict] = []
                        for a, b in ranges:
                            if own and own[-1]["end"] == a:
                                own[-1]["end"] = b
                            else:
                                own.append({"start": a, "end": b})
                        joined += own
                    ids.append(e.ids)
                    masks.append(mask.tolist())
                    loss.append(joined)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("conv_id"),
                        pa.array([len(t) for t in turns], pa.int64()),
                        pa.array([r[0] for r in rendered], pa.string()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array(masks, pa.list_(pa.bool_())),
                        pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=["conv_id", "n_turns", "formatted", "token_ids", "loss_mask", "loss_spans"],
                )

    return rows.mapInArrow(run, SCHEMA)


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted output alone."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens")}
            for i in range(batch.num_rows):
                text = batch.column("formatted")[i].as_py()
                turns = parse(text)
                loss = unescape("".join(text[s["start"] : s["end"]] for s in batch.column("loss_spans")[i].as_py()))
                out["conv_id"].append(batch.column("conv_id")[i].as_py())
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
                out["n_tokens"].append(batch.column("n_tokens")[i].as_py())
            yield pa.RecordBatch.from_pydict(out, pa.schema([(k, pa.string() if "sha256" in k else pa.int64()) for k in out]))

    return formatted.select("conv_id", "formatted", "loss_spans", F.size("token_ids").cast("long").alias("n_tokens")).mapInArrow(run, schema)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return digest(format_conversations(rows.unionByName(extra)))
