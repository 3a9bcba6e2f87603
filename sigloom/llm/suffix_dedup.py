"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

A string of WIDTH bytes is removed where it also starts earlier.  Suffixes only have
to be told apart to depth WIDTH, so the sort is bounded:

1. sample: positions whose offset modulo PERIOD lies in a difference cover.  For any
   two equal strings of WIDTH bytes some shift below PERIOD moves both starts onto
   sampled positions, so both hold equal sampled tuples of WIDTH-PERIOD+1 bytes;
2. name: tuples are dealt by hash, sorted, and get equal names where equal.  A name
   that occurs once ends the recursion for its suffix: nothing equals it;
3. recurse and merge: the suffixes up to PERIOD-1 bytes before a repeated name are the
   only ones still undecided.  They are named by their first WIDTH bytes (first by a short
   hash, which ends it for those that nothing equals), dealt and sorted, and in each run
   of adjacent equal prefixes all but the earliest are marked.

Names travel as packed hashes, one row for each block of documents and each hash
range, and only bits come back: no row per suffix, no text in a shuffle after the
documents were laid out.  A block sends a distinct name once, so a very frequent
string costs one entry a block.  Later exact copies of a whole document are settled
first by their digest: every string of theirs starts earlier in the first copy.

Prefixes are equal if 80 bits of two hashes and the range (6 bits and more, growing
with the input) are; tuples, which only propose, if 40 bits and the range are.  Defined cases: null text is empty; a null doc_id counts as the largest;
rows with equal doc_id and text are one document and each row is returned; rows with
equal doc_id and different texts are ordered by digest; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE2, prefix_sums, range_hash, release, shuffle_width, stored, text_bytes

WIDTH = 100
PERIOD = 57
# A perfect difference set modulo 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
BLOCK_LEAST, BLOCK_MOST = 1 << 20, 32 << 20  # text of a block of documents
RANGE_BYTES = 64 << 20  # text behind one hash range
TUPLE_BYTES = 5  # sent of a tuple's hash, beside its range
PREFIX_BYTES = 4  # sent of an undecided prefix's hash, before those that repeat are sent in full
LAST = (1 << 63) - 1
MARKS = "kind string, block long, doc_id long, digest string, range int, bits binary"


class Block:
    """A block's first copies in (doc_id, digest) order, as one byte array with document offsets."""

    def __init__(self, texts: pa.Table, marks: pa.Table) -> None:
        self.marks = marks
        keep = self.of("keep")
        wanted = set(zip(keep.column("doc_id").to_pylist(), keep.column("digest").to_pylist(), strict=True))
        rows: dict[tuple[int, str], int] = {}
        for i, key in enumerate(zip(texts.column("doc_id").to_pylist(), texts.column("digest").to_pylist(), strict=True)):
            if key in wanted:
                rows[key] = i
        self.keys = sorted(rows)
        self.data, self.offsets = text_bytes(texts.column("text").take(pa.array([rows[k] for k in self.keys], pa.int64())))

    def of(self, kind: str) -> pa.Table:
        return self.marks.filter(pc.equal(self.marks.column("kind"), kind))

    def answers(self, kind: str, h: np.ndarray, ranges: int) -> np.ndarray:
        """Bits that the hash ranges sent back for this block's sorted hashes h."""
        out, marks, bounds = np.zeros(len(h), bool), self.of(kind), range_bounds(h, ranges)
        for r, bits in zip(marks.column("range").to_pylist(), marks.column("bits").to_pylist(), strict=True):
            n = int(bounds[r + 1] - bounds[r])
            out[bounds[r] : bounds[r + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        return out


def range_bounds(h: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds of equal hash ranges in sorted hashes."""
    share = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(share, np.arange(ranges + 1, dtype=np.uint64))


def dealt(block: int, h: np.ndarray, packed: np.ndarray, ranges: int) -> pa.Table:
    """One row for each hash range that has hashes of this block; packed: the bytes sent of each."""
    bounds = range_bounds(h, ranges)
    some = np.flatnonzero(np.diff(bounds))
    return pa.table(
        {
            "range": pa.array(some, pa.int32()),
            "block": pa.array(np.full(len(some), block), pa.int64()),
            "hashes": pa.array([packed[bounds[r] : bounds[r + 1]].tobytes() for r in some], pa.binary()),
        }
    )


def answered(table: pa.Table, sizes: list[int], mark: np.ndarray, kind: str) -> pa.Table:
    ends = np.cumsum(sizes)
    bits = [np.packbits(mark[e - n : e]).tobytes() if mark[e - n : e].any() else None for e, n in zip(ends, sizes, strict=True)]
    n = table.num_rows
    out = {"kind": pa.array([kind] * n), "block": table.column("block"), "doc_id": pa.nulls(n, pa.int64()), "digest": pa.nulls(n, pa.string()), "range": table.column("range"), "bits": pa.array(bits, pa.binary())}
    return pa.table(out).filter(pc.is_valid(pa.array(bits, pa.binary())))


class Plan:
    """The bounded suffix sort's steps for given width, period, cover and number of hash ranges."""

    def __init__(self, width: int, period: int, cover: tuple[int, ...], ranges: int, whole_characters: bool) -> None:
        self.width, self.period, self.cover, self.ranges, self.whole_characters = width, period, cover, ranges, whole_characters

    def samples(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions that hold a whole tuple, and the tuples' hashes."""
        length, size = np.diff(b.offsets), self.width - self.period + 1
        marks = np.zeros(self.period, bool)
        marks[list(self.cover)] = True
        doc = np.repeat(np.arange(len(length)), length)
        at = np.arange(len(b.data)) - b.offsets[doc]
        at = np.flatnonzero(marks[at % self.period] & (at + size <= length[doc]))
        return at, range_hash(prefix_sums(b.data), at, at + size)

    def name_samples(self, key: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        b = Block(texts, marks)
        h = np.unique(self.samples(b)[1])
        return dealt(key[0].as_py(), h, h.view(np.uint8).reshape(-1, 8)[:, :TUPLE_BYTES], self.ranges)

    def undecided(self, b: Block) -> np.ndarray:
        """Suffixes that may equal another to depth width: up to period-1 bytes before a repeated name."""
        at, h = self.samples(b)
        distinct, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        again = at[((count > 1) | b.answers("name", distinct, self.ranges))[inverse]]
        step = np.zeros(len(b.data) + 1, np.int32)
        start = b.offsets[np.searchsorted(b.offsets, again, "right") - 1]
        np.add.at(step, np.maximum(again - self.period + 1, start), 1)
        np.add.at(step, again + 1, -1)
        places = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        return places[places + self.width <= b.offsets[np.searchsorted(b.offsets, places, "right")]]

    def prefixes(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Undecided suffixes sorted by prefix, then place: distinct prefixes' two hashes, places, prefix numbers."""
        places = self.undecided(b)
        h = range_hash(prefix_sums(b.data), places, places + self.width)
        g = range_hash(prefix_sums(b.data, BASE2), places, places + self.width, BASE2)
        order = np.argsort(h, kind="stable")
        h, g, places = h[order], g[order], places[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        return h[new], g[new], places, np.cumsum(new) - 1

    def name_undecided(self, key: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        h = self.prefixes(Block(texts, marks))[0]
        return dealt(key[0].as_py(), h, h.view(np.uint8).reshape(-1, 8)[:, :PREFIX_BYTES], self.ranges)

    def name_prefixes(self, key: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        b = Block(texts, marks)
        h, g, _, _ = self.prefixes(b)
        some = b.answers("prefix", h, self.ranges)
        h, g = h[some], g[some]
        both = np.concatenate((h.view(np.uint8).reshape(-1, 8)[:, :6], g.view(np.uint8).reshape(-1, 8)[:, :4]), axis=1)
        return dealt(key[0].as_py(), h, both, self.ranges)

    def cut(self, key: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        """Per document of a block: removed spans and what is left."""
        b = Block(texts, marks)
        h, _, places, number = self.prefixes(b)
        later = b.answers("prefix", h, self.ranges)
        later[later] = b.answers("later", h[later], self.ranges)
        gone = later[number]
        gone[1:] |= number[1:] == number[:-1]  # a later place in this very block
        step = np.zeros(len(b.data) + 1, np.int32)
        np.add.at(step, places[gone], 1)
        np.add.at(step, places[gone] + self.width, -1)
        covered = np.cumsum(step[:-1]) > 0
        edge = np.zeros(len(covered) + 1, bool)
        edge[b.offsets] = True
        before, after = np.concatenate(([False], covered[:-1])), np.concatenate((covered[1:], [False]))
        first = np.flatnonzero(covered & (~before | edge[:-1]))
        last = np.flatnonzero(covered & (~after | edge[1:])) + 1
        n, a, left = len(b.keys), np.searchsorted(first, b.offsets), b.data[~covered]
        kept = np.concatenate(([0], np.cumsum(~covered)))[b.offsets]
        rest = [left[kept[i] : kept[i + 1]].tobytes() for i in range(n)]
        if self.whole_characters:
            rest = [x.decode("utf-8", "ignore").encode() for x in rest]
        return pa.table(
            {
                "doc_id": pa.array([k[0] for k in b.keys], pa.int64()),
                "digest": pa.array([k[1] for k in b.keys], pa.string()),
                "n_bytes": pa.array(np.diff(b.offsets), pa.int64()),
                "starts": pa.array([first[a[i] : a[i + 1]] - b.offsets[i] for i in range(n)], pa.list_(pa.int64())),
                "ends": pa.array([last[a[i] : a[i + 1]] - b.offsets[i] for i in range(n)], pa.list_(pa.int64())),
                "kept": pa.array(rest, pa.binary()),
            }
        )


def repeated_names(table: pa.Table, kind: str, size: int) -> pa.Table:
    """Of one hash range: sort the names; for each block, which occur in another block too."""
    raw = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, size) for x in table.column("hashes").combine_chunks()]
    wide = np.zeros((sum(map(len, raw)), 8), np.uint8)
    np.concatenate(raw, out=wide[:, :size])
    names = wide.view(np.uint64)[:, 0]
    ordered = np.sort(names)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return answered(table, [len(x) for x in raw], np.isin(names, again), kind)


def later_prefixes(table: pa.Table) -> pa.Table:
    """Of one hash range: sort prefixes, compare neighbours, mark all but the first block's of each run."""
    raw = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 10) for x in table.column("hashes").combine_chunks()]
    wide = np.zeros((sum(map(len, raw)), 16), np.uint8)
    np.concatenate(raw, out=wide[:, :10])
    names = wide.view(np.uint64)
    block = np.repeat(np.array(table.column("block").to_pylist(), np.int64), [len(x) for x in raw])
    order = np.lexsort((block, names[:, 1], names[:, 0]))
    ordered = names[order]
    later = np.zeros(len(names), bool)
    later[order[1:]] = (ordered[1:] == ordered[:-1]).all(axis=1)
    return answered(table, [len(x) for x in raw], later, "later")


def _rows(documents: DataFrame) -> DataFrame:
    """doc_id (null as the largest) and text (null as empty)."""
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _digest(text: str = "text") -> Callable:
    return F.sha2(F.col(text).cast("binary"), 256)


def repeated_spans(documents: DataFrame, then: Callable[[DataFrame], DataFrame] = lambda spans: spans, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, whole_characters: bool = False) -> DataFrame:
    """(doc_id, digest, n_bytes, starts, ends, kept): removed byte spans and what is left, for the
    first document of each text; kept is binary, as a cut may fall inside a character, unless
    whole_characters widens the cuts.

    `then` is applied before the result is written to the shared folder; the working table is
    dropped after that."""
    spark = documents.sparkSession
    rows = _rows(documents)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width_now = shuffle_width(spark)
    blocks = max(1, math.ceil(total / min(BLOCK_MOST, max(BLOCK_LEAST, 32 * math.isqrt(total)))))
    ranges = min(1 << 16, width_now * max(1, math.ceil(total / width_now / RANGE_BYTES)))
    # blocks are ranges of (doc_id, digest), so that a block's number orders its documents against
    # others; repeats of one row spread over blocks, of which the first keeps its document
    placed = rows.withColumn("digest", _digest()).withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
    placed = placed.repartitionByRange(blocks, "doc_id", "digest", "row").select(F.spark_partition_id().cast("long").alias("block"), "doc_id", "digest", "text")
    table = f"texts_{uuid.uuid4().hex}"
    placed.write.bucketBy(width_now, "block").sortBy("block").option("compression", "zstd").saveAsTable(table)
    release(spark)
    try:
        texts = spark.table(table)
        firsts = texts.groupBy("digest").agg(F.min(F.struct("doc_id", "block")).alias("f"))
        nothing = {"range": F.lit(None).cast("int"), "bits": F.lit(None).cast("binary")}
        keep = stored(firsts.select(F.lit("keep").alias("kind"), "f.block", "f.doc_id", "digest").withColumns(nothing), "keep")
        plan = Plan(width, period, cover, ranges, whole_characters)
        sent = "range int, block long, hashes binary"
        blocked = texts.groupBy("block")
        names = blocked.cogroup(keep.groupBy("block")).applyInArrow(lambda k, t, m: plan.name_samples(k, t, m), sent)
        marks = keep.unionByName(stored(names.groupBy("range").applyInArrow(lambda t: repeated_names(t, "name", TUPLE_BYTES), MARKS), "named"))
        names = blocked.cogroup(marks.groupBy("block")).applyInArrow(lambda k, t, m: plan.name_undecided(k, t, m), sent)
        marks = marks.unionByName(stored(names.groupBy("range").applyInArrow(lambda t: repeated_names(t, "prefix", PREFIX_BYTES), MARKS), "named"))
        names = blocked.cogroup(marks.groupBy("block")).applyInArrow(lambda k, t, m: plan.name_prefixes(k, t, m), sent)
        marks = marks.unionByName(stored(names.groupBy("range").applyInArrow(later_prefixes, MARKS), "later"))
        schema = "doc_id long, digest string, n_bytes long, starts array<long>, ends array<long>, kept binary"
        return stored(then(blocked.cogroup(marks.groupBy("block")).applyInArrow(lambda k, t, m: plan.cut(k, t, m), schema)), "spans")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def digest(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """The contract's columns for every row of documents."""
    removed = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda a, x: a + x["ends"] - x["starts"])
    columns = ("doc_id", "digest", removed.alias("removed"), F.size("starts").cast("long").alias("spans"), F.sha2("kept", 256).alias("sha"))
    found = repeated_spans(documents, lambda spans: spans.select(*columns), width)
    rows = _rows(documents).select("doc_id", _digest().alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    whole = F.col("removed").isNull() & (F.col("n_bytes") >= width)  # a later copy of a whole text
    zero = F.lit(0).cast("long")
    return rows.join(found, ["doc_id", "digest"], "left").select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("sha", "digest")).alias("kept_sha256"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple[int, bytes]], width: int = WIDTH) -> dict[int, list[tuple[int, int]]]:
    """Removed spans by doc_id, by looking up every string of width bytes; for tests."""
    seen: set[bytes] = set()
    out: dict[int, list[tuple[int, int]]] = {}
    for doc_id, data in sorted(rows):
        spans: list[tuple[int, int]] = []
        for i in range(len(data) - width + 1):
            piece = data[i : i + width]
            if piece in seen:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + width)
                else:
                    spans.append((i, i + width))
            seen.add(piece)
        out[doc_id] = spans
    return out
