r"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`: an automaton of
four states.  Edits are Keep (0), Rerole to user or assistant (1), Delete (2) and Insert of an
empty user or assistant turn anywhere (5); blank and duplicate turns have to be deleted, and a
truncated turn that stays costs 5 more.  Of the cheapest edits those are taken whose initials
are least in ASCII order.

Four-state vectors do the work: forward from a start state, with the least cost of each state
and the order of the four audits so far; backward from an end state, with costs alone.  They
meet in the middle of a conversation, the crossing with the least sum and, of these, the least
audit is taken (two audits that end with a row's edit in different states differ before either
ends, so their order never depends on what follows), and both halves are repaired the same
way.  Nothing but the vectors and the edits is kept: space is linear in the turns.

Long conversations are cut into blocks of BLOCK turns, or of what a task has of them.  A block
is summed up in four by four costs and orders, which compose as the turns do; a conversation's
summaries, in order, give every block its start and end state, and each block is repaired on
its own.  Rows are spread by (conversation, turn, role, text), so a conversation with a third of
all rows is the work of many tasks, and equal rows are counted before they are shuffled.

The digest of a conversation is SHA-256 of all its text, a chain that cannot be cut: it runs
over the repaired blocks in order, one block at a time, in one task a conversation.

Defined cases: a null role or text is one space, and a null conv_id or turn is one in the damage
key `conv_id:turn`; rows go by turn (nulls first), then role and text; a role has to have an
initial to be kept; rows with a null conv_id are one conversation; repeated rows are rows of
their own (and duplicates); a conversation of which no row is left has zeros; extra columns are
ignored; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from .common import shuffle_width, stored

BLOCK = 4096  # turns
BLOCK_BYTES = 2 << 20  # of their text
FAR = 1 << 60  # a cost that nothing has

# States of the automaton (start, after s, after u, after a), what leads on from them,
# and what inserted or changed turns are
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = ("u", "u", "a", "u")
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5


@cache
def row_steps(kind: str, copies: int) -> tuple:
    """For each start and end state the cheapest (cost, edits) over a row of this kind, inserts before it included.

    A kind is `d` for a row that has to go, else the role's initial, with `t` behind it if truncated;
    copies: so many equal rows, of which all have to go."""
    out: list[list] = [[(FAR, "")] * 4 for _ in range(4)]
    for start in range(4):
        state, cost, edits = start, 0, ""
        for _ in range(4):  # after three inserts every state has been seen
            options = [(state, DELETE * copies, "D" * copies)]
            if kind != "d":
                more = TRUNCATED * kind.endswith("t")
                if (to := NEXT[state].get(kind[:1])) is not None:
                    options.append((to, more, "K"))
                options.append((NEXT[state][MADE[state]], REROLE + more, "R"))
            for to, price, letters in options:
                out[start][to] = min(out[start][to], (cost + price, edits + letters))
            state, cost, edits = NEXT[state][MADE[state]], cost + INSERT, edits + "I"
    return tuple(map(tuple, out))


@cache
def row_matrix(kind: str, copies: int) -> tuple:
    """row_steps with the order of the edits in place of these: for each start state (end state, cost, order)."""
    out = []
    for line in row_steps(kind, copies):
        order = sorted(range(4), key=lambda c, line=line: line[c][1])
        out.append(tuple((c, line[c][0], order.index(c)) for c in range(4) if line[c][0] < FAR))
    return tuple(out)


@cache
def closing(state: int) -> tuple[int, str]:
    """(cost, inserts) from a state behind the last row to the end."""
    cost, edits = 0, ""
    while state not in ENDS:
        state, cost, edits = NEXT[state][MADE[state]], cost + INSERT, edits + "I"
    return cost, edits


Vector = list  # of four (cost, order)


def forward(vector: Vector, matrix: tuple) -> Vector:
    """The vector behind a row or block; orders are those of the audits, 0 to 3."""
    best: list = [(FAR, 0, 0)] * 4
    for s in range(4):
        cost, order = vector[s]
        if cost < FAR:
            for c, price, tail in matrix[s]:
                best[c] = min(best[c], (cost + price, order, tail))
    place = {k: i for i, k in enumerate(sorted({x[1:] for x in best}))}
    return [(x[0], place[x[1:]]) for x in best]


def backward(costs: list[int], matrix: tuple) -> list[int]:
    return [min((price + costs[c] for c, price, _ in matrix[s]), default=FAR) for s in range(4)]


def single(state: int) -> Vector:
    return [(0 if s == state else FAR, 0) for s in range(4)]


def crossings(rows: list[tuple[str, int]], start: int, end: int) -> Iterator[tuple[int, int]]:
    """(state before, state behind) of each row on the cheapest, then least way from start to end."""
    todo = [(0, len(rows), start, end)]
    while todo:
        lo, hi, start, end = todo.pop()
        if hi - lo == 1:
            yield start, end
            continue
        if hi == lo:
            continue
        mid = (lo + hi) // 2
        ahead = single(start)
        for r in rows[lo:mid]:
            ahead = forward(ahead, row_matrix(*r))
        back = [0 if s == end else FAR for s in range(4)]
        for r in reversed(rows[mid:hi]):
            back = backward(back, row_matrix(*r))
        cross = min(range(4), key=lambda s: (ahead[s][0] + back[s], ahead[s][1]))
        todo.append((mid, hi, cross, end))
        todo.append((lo, mid, start, cross))


def composed(matrices: list[tuple]) -> tuple:
    """Costs and orders of several rows or blocks in turn, as row_matrix has them for a row."""
    out = []
    for start in range(4):
        vector = single(start)
        for m in matrices:
            vector = forward(vector, m)
        out.append(tuple((c, cost, order) for c, (cost, order) in enumerate(vector) if cost < FAR))
    return tuple(out)


def last_state(vector: Vector) -> int:
    """Best state behind the last row."""
    return min(range(4), key=lambda s: (vector[s][0] + closing(s)[0], vector[s][1]))


def edge_states(matrices: list[tuple], start: int, end: int | None) -> list[int]:
    """The state at each edge of the blocks between start and end; without end, the best one."""
    vectors = [single(start)]
    for m in matrices:
        vectors.append(forward(vectors[-1], m))
    state = last_state(vectors[-1]) if end is None else end
    out = [state]
    for m, vector in zip(reversed(matrices), reversed(vectors[:-1]), strict=True):
        into = [(vector[s][0] + price, vector[s][1], s) for s in range(4) for c, price, _ in m[s] if c == state and vector[s][0] < FAR]
        state = min(into)[2]
        out.append(state)
    return out[::-1]


def repair_block(rows: list[dict], start: int, end: int, last: bool) -> tuple[str, list[str]]:
    """(edits, repaired `role:text` lines) of a block's rows from its start to its end state."""
    kinds = [(r["kind"], r["copies"]) for r in rows]
    audit, lines = [], []
    for row, kind, (before, behind) in zip(rows, kinds, crossings(kinds, start, end), strict=True):
        edits = row_steps(*kind)[before][behind][1]
        audit.append(edits)
        for letter in edits:
            if letter in "IR":
                lines.append(f"{NAMES[MADE[before]]}:{row['text'] if letter == 'R' else ''}")
                before = NEXT[before][MADE[before]]
            elif letter == "K":
                lines.append(f"{row['role']}:{row['text']}")
    if last:
        edits = closing(end)[1]
        audit.append(edits)
        for _ in edits:
            lines.append(f"{NAMES[MADE[end]]}:")
            end = NEXT[end][MADE[end]]
    return "".join(audit), lines


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the contract's damage; copies: equal rows."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(way == 4, "user").otherwise(space("role"))
    rows = conversations.filter(way != 0).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(way == 3, 2).otherwise(1).cast("long").alias("copies"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """The damaged rows with the fault and the kind (see row_steps) of each; equal rows behind the first are a row of their own."""
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.withColumn("digest", digest)
    # the first of equal role and text: a minimum, and a join that Spark can split where a turn is repeated without end
    first = rows.groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").select(F.col("conv_id").alias("conv"), F.col("digest").alias("same"), "first")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("digest") == F.col("same")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    rows = rows.select("conv_id", "turn", "role", "text", "copies", initial.alias("initial"), F.when(blank, "blank").when(later, "duplicate").when(cut, "truncated").alias("fault"))
    goes = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    kind = F.concat(F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x"), F.when(F.col("fault") == "truncated", "t").otherwise(""))
    part = lambda again, fault, kind, copies: F.struct(F.lit(again).alias("again"), fault.alias("fault"), kind.alias("kind"), copies.alias("copies"))
    whole = F.array(part(0, F.col("fault"), F.lit("d"), F.col("copies")))
    apart = F.array(part(0, F.col("fault"), kind, F.lit(1).cast("long")), part(1, F.lit("duplicate"), F.lit("d"), F.col("copies") - 1))
    parts = F.when(goes, whole).otherwise(F.filter(apart, lambda x: x["copies"] > 0))
    return rows.select("conv_id", "turn", "role", "text", "initial", F.explode(parts).alias("p")).select("conv_id", "turn", "role", "text", "initial", "p.*")


ORDER = ("conv_id", "turn", "role", "text", "again")
COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = frozenset(("su", "ua", "au"))


def flat(matrix: tuple) -> list[int]:
    """A matrix as numbers: four by four costs and orders."""
    out = [FAR, 0] * 16
    for s, line in enumerate(matrix):
        for c, cost, order in line:
            out[8 * s + 2 * c : 8 * s + 2 * c + 2] = cost, order
    return out


def unflat(numbers: list[int]) -> tuple:
    return tuple(tuple((c, numbers[8 * s + 2 * c], numbers[8 * s + 2 * c + 1]) for c in range(4) if numbers[8 * s + 2 * c] < FAR) for s in range(4))


def summary(rows: list[dict]) -> dict:
    """Counts, edges and matrix of rows in order."""
    out = dict.fromkeys(COUNTS, 0)
    before, turns = None, [r["turn"] for r in rows if r["turn"] is not None]
    for r in rows:
        if r["fault"]:
            out[r["fault"]] += r["copies"]
        out["illegal"] += (before is not None and before + r["initial"] not in LEGAL) + (r["copies"] - 1) * (2 * r["initial"] not in LEGAL)
        before = r["initial"]
    edges = {"first": rows[0]["initial"], "last": before, "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None)}
    return out | edges | {"matrix": flat(composed([row_matrix(r["kind"], r["copies"]) for r in rows]))}


def joined(parts: list[dict]) -> dict:
    """The summary of neighbouring parts."""
    out = {c: sum(p[c] for p in parts) for c in (*COUNTS, "turns")}
    for a, b in zip(parts, parts[1:], strict=False):
        out["illegal"] += a["last"] + b["first"] not in LEGAL
        out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    turns = [x for p in parts for x in (p["low"], p["high"]) if x is not None]
    return out | {"first": parts[0]["first"], "last": parts[-1]["last"], "low": min(turns, default=None), "high": max(turns, default=None), "matrix": flat(composed([unflat(p["matrix"]) for p in parts]))}


TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("kind", pa.string()), ("copies", pa.int64())])
SUMMARY = [("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in (*COUNTS, "turns", "low", "high")], ("matrix", pa.list_(pa.int64()))]
BLOCKS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("number", pa.int64()), *SUMMARY, ("rows", pa.list_(TURN))])
RUNS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), *SUMMARY, ("numbers", pa.list_(pa.int64())), ("matrices", pa.list_(pa.list_(pa.int64())))])
STATES = pa.schema([("part", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("whole", pa.bool_()), ("last", pa.bool_())])
CONVERSATIONS = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", *COUNTS, "cost")], ("states", pa.list_(pa.struct(list(STATES))))])
REPAIRED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("number", pa.int64()), ("whole", pa.bool_()), ("audit", pa.string()), ("lines", pa.list_(pa.string()))])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _spark(schema: pa.Schema) -> StructType:
    return from_arrow_schema(schema)


def _batches(rows: Iterator[dict], schema: pa.Schema, weight: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most some megabytes."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 1000 + weight(row)
        if size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _read(batches: Iterator[pa.RecordBatch], many: int = 256) -> Iterator[dict]:
    for batch in batches:
        for lo in range(0, batch.num_rows, many):
            yield from batch.slice(lo, many).to_pylist()


def blocks(rows: DataFrame) -> DataFrame:
    """Marked rows in order, packed into blocks that are numbered within their task, with a summary each; stored."""
    ordered = rows.repartitionByRange(shuffle_width(rows.sparkSession), *ORDER).sortWithinPartitions(*ORDER)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, number, own, size = TaskContext.get().partitionId(), 0, [], 0
        name = lambda: {"conv_id": own[0]["conv_id"], "part": part, "number": number, "rows": own} | summary(own)
        for row in _read(batches):
            if own and (row["conv_id"] != own[0]["conv_id"] or len(own) >= BLOCK or size >= BLOCK_BYTES):
                yield name()
                number, own, size = number + 1, [], 0
            own.append(row)
            size += len(row["text"])
        if own:
            yield name()

    run = lambda batches: _batches(cut(batches), BLOCKS, lambda b: sum(len(r["text"]) for r in b["rows"]))
    return stored(ordered.mapInArrow(run, _spark(BLOCKS)), "blocks")


def _listed(rows: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """A list of rows for each key, in order."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("parts"))


def runs(found: DataFrame) -> DataFrame:
    """What a task has of a conversation, from its blocks; stored."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for r in _read(batches):
            yield {"conv_id": r["conv_id"], "part": r["part"], "numbers": [p["number"] for p in r["parts"]], "matrices": [p["matrix"] for p in r["parts"]]} | joined(r["parts"])

    run = lambda batches: _batches(join(batches), RUNS, lambda r: 300 * len(r["numbers"]))
    return stored(_listed(found, ["conv_id", "part"], "number", [n for n, _ in SUMMARY]).mapInArrow(run, _spark(RUNS)), "runs")


def conversations_of(found: DataFrame) -> DataFrame:
    """Counts, cost and the states of the runs of each conversation, from its runs (a task has one at most); stored."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for r in _read(batches):
            total, matrices = joined(r["parts"]), [unflat(p["matrix"]) for p in r["parts"]]
            edges = edge_states(matrices, 0, None)
            vector = forward(single(0), unflat(total["matrix"]))
            cost = vector[edges[-1]][0] + closing(edges[-1])[0]
            gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
            many = len(matrices)
            states = [{"part": p["part"], "start": a, "end": b, "whole": many == 1, "last": i == many - 1} for i, (p, a, b) in enumerate(zip(r["parts"], edges, edges[1:], strict=False))]
            yield {"conv_id": r["conv_id"], "gaps": gaps, "cost": cost, "states": states} | {c: total[c] for c in COUNTS}

    run = lambda batches: _batches(solve(batches), CONVERSATIONS, lambda r: 40 * len(r["states"]))
    return stored(_listed(found, ["conv_id"], "part", [n for n, _ in SUMMARY]).mapInArrow(run, _spark(CONVERSATIONS)), "conversations")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, gaps, COUNTS, cost of each conversation of the marked rows; its repaired blocks, see REPAIRED).

    A conversation's lines in order of (part, number) are its repaired turns, as `role:text`."""
    packed = blocks(rows)
    own = runs(packed.drop("rows"))
    found = conversations_of(own.drop("numbers", "matrices"))
    states = found.select("conv_id", F.explode("states").alias("s")).select("conv_id", "s.*")
    same = F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r.part") == F.col("s.part"))
    asked = own.select("conv_id", "part", "numbers", "matrices").alias("r").join(states.alias("s"), same).select("s.*", "numbers", "matrices")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in _read([batch]):
                edges = edge_states([unflat(m) for m in r["matrices"]], r["start"], r["end"])
                many = len(r["numbers"])
                out += [{"part": r["part"], "number": n, "start": a, "end": b, "whole": r["whole"] and many == 1, "last": r["last"] and i == many - 1} for i, (n, a, b) in enumerate(zip(r["numbers"], edges, edges[1:], strict=False))]
            yield pa.RecordBatch.from_pylist(out, STATES.insert(1, pa.field("number", pa.int64())))

    edges = asked.mapInArrow(inner, "part long, number long, start long, end long, whole boolean, last boolean")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in _read(batches, 16):
            audit, lines = repair_block(b["rows"], b["start"], b["end"], b["last"])
            yield {"conv_id": b["conv_id"], "part": b["part"], "number": b["number"], "whole": b["whole"], "audit": audit, "lines": lines}

    run = lambda batches: _batches(write(batches), REPAIRED, lambda b: sum(map(len, b["lines"])))
    return found.drop("states"), packed.select("conv_id", "part", "number", "rows").join(edges, ["part", "number"]).mapInArrow(run, _spark(REPAIRED))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of repaired blocks; those that are a whole conversation stay where they are."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv_id, audit, sha, any_line = None, None, None, False
        done = lambda: {"conv_id": conv_id, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
        for b in _read(batches, 16):
            if audit is not None and (b["whole"] or b["conv_id"] != conv_id):
                yield done()
                audit = None
            if audit is None:
                conv_id, audit, sha, any_line = b["conv_id"], [], hashlib.sha256(), False
            audit.append(b["audit"])
            if b["lines"]:
                sha.update(("\n" * any_line + "\n".join(b["lines"])).encode())
                any_line = True
        if audit is not None:
            yield done()

    run = lambda batches: _batches(chain(batches), DIGESTS, lambda b: len(b["audit"]))
    cut = repaired.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return repaired.filter("whole").mapInArrow(run, _spark(DIGESTS)).unionByName(cut.mapInArrow(run, _spark(DIGESTS)))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """The contract's columns, one row per conv_id of the undamaged rows."""
    found, lines = repair(marked(damaged(conversations)))
    lines = stored(lines, "repaired")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    named = lambda df, alias: df.withColumnRenamed("conv_id", alias)
    out = ids.join(named(found, "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").join(named(digests(lines), "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *COUNTS, "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
bits AS (SELECT *, flatten(list_transform(string_split(key, ''), lambda ch: list_transform(range(8), lambda j: (ascii(ch) >> j) & 1))) AS bits FROM raw),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295, bits), lambda c, b: CASE WHEN (xor(c, b) & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS way FROM bits),
damaged AS (SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE way WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE way <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM damaged),
r AS (SELECT *, substr(role, 1, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
leads(s, i, e, name) AS (VALUES (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
ins(s, e, price, letters, lines) AS (SELECT s, s, 0, '', CAST([] AS VARCHAR[]) FROM range(4) AS t(s)
    UNION ALL SELECT ins.s, leads.e, price + 5, letters || 'I', list_append(lines, name || ':') FROM ins JOIN leads ON ins.e = leads.s AND name IS NOT NULL WHERE length(letters) < 3),
opt AS (SELECT ins.s, ins.e AS m, ins.e AS e, price + 2 AS price, letters || 'D' AS letters, lines, 'D' AS edit, CAST(NULL AS VARCHAR) AS i, CAST(NULL AS VARCHAR) AS name FROM ins
    UNION ALL SELECT ins.s, ins.e, leads.e, price, letters || 'K', lines, 'K', i, CAST(NULL AS VARCHAR) FROM ins JOIN leads ON ins.e = leads.s
    UNION ALL SELECT ins.s, ins.e, leads.e, price + 1, letters || 'R', lines, 'R', CAST(NULL AS VARCHAR), name FROM ins JOIN leads ON ins.e = leads.s AND name IS NOT NULL),
way AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM r)
    UNION ALL SELECT conv_id, k, s, best.cost, best.audit, best.lines FROM (
        SELECT way.conv_id, r.k, opt.e AS s, min({'cost': cost + price + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END, 'audit': audit || letters,
            'lines': way.lines || opt.lines || CASE edit WHEN 'K' THEN [r.role || ':' || r.text] WHEN 'R' THEN [opt.name || ':' || r.text] ELSE [] END}) AS best
        FROM way JOIN r ON r.conv_id IS NOT DISTINCT FROM way.conv_id AND r.k = way.k + 1 JOIN opt ON opt.s = way.s
        WHERE edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR opt.i = r.i)) GROUP BY ALL)),
n AS (SELECT conv_id, max(k) AS k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM r GROUP BY conv_id),
pairs AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i AS p, k FROM r) WHERE k > 1 AND p NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
done AS (SELECT way.conv_id, min({'cost': cost + price, 'audit': audit || letters, 'lines': way.lines || ins.lines}) AS best
    FROM way JOIN n ON n.conv_id IS NOT DISTINCT FROM way.conv_id AND n.k = way.k JOIN ins ON ins.s = way.s AND ins.e IN (0, 3) GROUP BY way.conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN pairs ON pairs.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
"""
