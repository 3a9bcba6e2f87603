"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments.  A segment covers whole documents (SEGMENT_BYTES of
text) and stores, for every token of those documents, a posting: the token's position,
grouped by term, positions ascending.  A phrase query starts from its locally rarest
term and intersects the other terms' posting lists at shifted positions.

Queries are the distinct (window, item) pairs of the benchmark, cut into blocks of at
most QUERY_WORDS words by hash on the executors; the driver sends one block at a time.
Against a segment a block looks up each of its distinct terms once, and then only the
windows all of whose terms the segment has.

Defined cases: a null text has no words; items or documents without words never
match; a null item_id is named by the empty string; repeated rows are separate rows and
each is reported; a null doc_id stays null; extra columns are ignored; an empty
benchmark hits nothing.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, SLICE_BYTES, slices, stored, text_bytes, words

WINDOW = 10
QUERY_WORDS = 4_000_000  # words of query windows sent at once: 32 MB of term hashes
SEGMENT_BYTES = 4 << 20

SEGMENT = T.StructType(
    [
        T.StructField("segment", T.LongType()),  # unique: partition and number within it
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("digests", T.ArrayType(T.BinaryType())),  # SHA-256 of each text
        T.StructField("counts", T.ArrayType(T.LongType())),  # words of each document
        T.StructField("terms", T.BinaryType()),  # uint64: sorted distinct terms
        T.StructField("heads", T.BinaryType()),  # int64: first posting of each term, and the end
        T.StructField("postings", T.BinaryType()),  # int32: positions, ascending within a term
    ]
)


def _segment(segment: int, ids: list, digests: list, counts: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    terms, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    order = np.argsort(inverse.astype(np.int32), kind="stable").astype(np.int32)
    heads = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(terms)))))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([segment], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([digests], pa.list_(pa.binary())),
            pa.array([np.concatenate(counts)], pa.list_(pa.int64())),
            pa.array([terms.tobytes()], pa.binary()),
            pa.array([heads.astype(np.int64).tobytes()], pa.binary()),
            pa.array([order.tobytes()], pa.binary()),
        ],
        names=SEGMENT.names,
    )


def _segments(least: int) -> Callable:
    """Segments of at least so many bytes of text (but for a task's last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, digests, counts, hashes, size = [], [], [], [], 0
        for batch in batches:
            for part in slices(batch, limit=min(SLICE_BYTES, least)):
                data, offsets = text_bytes(part.column("text"))
                h, _, _, starts = words(data, offsets, ALNUM)
                ids += part.column("doc_id").to_pylist()
                digests += part.column("digest").to_pylist()
                counts.append(np.diff(starts))
                hashes.append(h)
                size += len(data)
                if size >= least:
                    yield _segment(number, ids, digests, counts, hashes)
                    number += 1
                    ids, digests, counts, hashes, size = [], [], [], [], 0
        if ids:
            yield _segment(number, ids, digests, counts, hashes)

    return run


def build_index(documents: DataFrame) -> DataFrame:
    """Token postings of all documents, stored in the shared folder."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))
    return stored(rows.mapInArrow(_segments(SEGMENT_BYTES), SEGMENT), "postings")


class Segment:
    """One segment's postings with vectorised lookups."""

    def __init__(self, row: dict) -> None:
        self.segment, self.doc_ids = row["segment"], row["doc_ids"]
        self.starts = np.concatenate(([0], np.cumsum(np.array(row["counts"], np.int64))))
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.heads = np.frombuffer(row["heads"], np.int64)
        self.postings = np.frombuffer(row["postings"], np.int32)
        self.n = len(self.postings)
        # one ascending key for every (term, position): membership by binary search
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.heads)) * (self.n + 1) + self.postings

    def term_ids(self, h: np.ndarray) -> np.ndarray:
        """Index of each term hash, -1 where the segment lacks it."""
        if not len(self.terms):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * (self.n + 1) + position
        at = np.minimum(np.searchsorted(self.keys, key), max(self.n - 1, 0))
        return (position >= 0) & (position < self.n) & (self.keys[at] == key)

    def phrases(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, start position) of every exact match; ids: queries x words, term ids."""
        found = np.flatnonzero((ids >= 0).all(axis=1))
        if not len(found):
            return found, found
        ids = ids[found]
        size = np.diff(self.heads)[ids]
        order = np.argsort(size, axis=1, kind="stable")
        rows = np.arange(len(ids))
        rare, count = ids[rows, order[:, 0]], size[rows, order[:, 0]]
        query = np.repeat(rows, count)
        begin = np.repeat(self.heads[rare], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = self.postings[begin].astype(np.int64) - np.repeat(order[:, 0], count)
        for k in range(1, ids.shape[1]):
            offset = order[query, k]
            ok = self.has(ids[query, offset], start + offset)
            query, start = query[ok], start[ok]
        doc = np.searchsorted(self.starts, start, "right") - 1
        ok = (start >= 0) & (start + ids.shape[1] <= self.starts[np.minimum(doc + 1, len(self.starts) - 1)])
        return found[query[ok]], start[ok]


def _windows(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column("text"))
                h, _, _, starts = words(data, offsets, ALNUM)
                items = part.column("item_id").to_pylist()
                out: dict[str, list] = {"terms": [], "item": []}
                for i, count in enumerate(np.diff(starts).tolist()):
                    n = min(width, count)
                    out["terms"] += [h[k : k + n].tobytes() for k in range(starts[i], starts[i] + count - n + 1)] if n else []
                    out["item"] += [items[i]] * (len(out["terms"]) - len(out["item"]))
                yield pa.RecordBatch.from_pydict(out, pa.schema([("terms", pa.binary()), ("item", pa.string())]))

    return run


@dataclass
class Queries:
    """A block of windows: their terms as numbers into a sorted vocabulary, and the items of each."""

    terms: np.ndarray
    windows: dict[int, np.ndarray]  # by length: windows x length
    items: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: first item of each window and the end, items
    names: list[str]


def _pack(table: pa.Table) -> pa.Table:
    """One row for a block of (terms, item) rows."""
    raw, items = table.column("terms").to_pylist(), table.column("item").to_pylist()
    names = sorted(set(items))
    place = {x: i for i, x in enumerate(names)}
    terms = np.unique(np.frombuffer(b"".join(raw), np.uint64))
    windows, owners = {}, {}
    for size in sorted({len(x) for x in raw}):
        pairs = sorted((w, place[x]) for w, x in zip(raw, items, strict=True) if len(w) == size)
        flat = np.frombuffer(b"".join(w for w, _ in pairs), np.uint64).reshape(len(pairs), -1)
        new = np.ones(len(pairs), bool)
        new[1:] = (flat[1:] != flat[:-1]).any(axis=1)
        windows[size // 8] = np.searchsorted(terms, flat[new]).astype(np.int32)
        owners[size // 8] = (np.append(np.flatnonzero(new), len(pairs)), np.array([x for _, x in pairs], np.int32))
    return pa.table({"block": table.column("block")[:1], "payload": pa.array([pickle.dumps(Queries(terms, windows, owners, names))], pa.binary())})


def query_blocks(benchmark: DataFrame, width: int = WINDOW) -> tuple[DataFrame, int]:
    """(block, payload) of the benchmark's query blocks, and how many there are."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    found = stored(rows.mapInArrow(_windows(width), "terms binary, item string").distinct(), "windows")
    blocks = math.ceil(found.count() * width / QUERY_WORDS)
    block = F.pmod(F.xxhash64("terms", "item"), F.lit(max(1, blocks))).alias("block")
    return stored(found.select(block, "terms", "item").groupBy("block").applyInArrow(_pack, "block long, payload binary"), "queries"), blocks


HITS = "segment long, ordinal long, spans array<struct<start:long,end:long>>, items array<string>"


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each owner, those that overlap or touch as one; sorted by owner and start."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(end + owner * far)
    new = np.ones(len(owner), bool)
    new[1:] = start[1:] + owner[1:] * far > reach[:-1]
    heads = np.flatnonzero(new)
    return owner[heads], start[heads], np.maximum.reduceat(end, heads)


def _span_lists(owner: np.ndarray, start: np.ndarray, end: np.ndarray, owners: np.ndarray) -> pa.Array:
    flat = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(owner, owners), len(owner)), pa.int32()), flat)


def phrase_matches(index: DataFrame, queries: Queries) -> DataFrame:
    """(segment, ordinal, spans, items) of documents that hold a query: merged word spans, items in order."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                known = seg.term_ids(asked.terms)
                docs, starts, ends, owners, items = ([np.zeros(0, np.int64)] for _ in range(5))
                for n, windows in asked.windows.items():
                    some = np.arange(len(windows))
                    for k in range(n):  # windows that lack a term go, term by term
                        some = some[known[windows[some, k]] >= 0]
                    query, start = seg.phrases(known[windows[some]])
                    doc = np.searchsorted(seg.starts, start, "right") - 1
                    docs.append(doc)
                    starts.append(start - seg.starts[doc])
                    ends.append(start - seg.starts[doc] + n)
                    heads, names = asked.items[n]
                    pair = np.unique(doc * len(windows) + some[query])
                    doc, query = pair // len(windows), pair % len(windows)
                    many = heads[query + 1] - heads[query]
                    at = np.repeat(heads[query], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    owners.append(np.repeat(doc, many))
                    items.append(names[at])
                owner, start, end = merged(*(np.concatenate(x) for x in (docs, starts, ends)))
                hit = np.unique(owner)
                pair = np.unique(np.concatenate(owners) * max(1, len(asked.names)) + np.concatenate(items))
                who, what = pair // max(1, len(asked.names)), pair % max(1, len(asked.names))
                names = pa.array([asked.names[i] for i in what.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(hit), seg.segment), pa.int64()),
                        pa.array(hit, pa.int64()),
                        _span_lists(owner, start, end, hit),
                        pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(who, hit), len(who)), pa.int32()), names),
                    ],
                    names=["segment", "ordinal", "spans", "items"],
                )

    return index.mapInArrow(search, HITS)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose spans came from several blocks: merged."""
    for batch in batches:
        spans = batch.column("spans")
        owner = np.repeat(np.arange(len(spans)), pc.list_value_length(spans).to_numpy())
        flat = spans.flatten()
        parts = merged(owner, flat.field("start").to_numpy(), flat.field("end").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("ordinal"), _span_lists(*parts, np.arange(len(spans))), batch.column("items")], names=batch.schema.names)


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, digest (SHA-256 of its text), n_words, hit spans (word offsets, merged), items that occur."""
    index = build_index(documents)
    packed, blocks = query_blocks(benchmark, width)
    hits = documents.sparkSession.createDataFrame([], HITS)
    for block in range(blocks):
        for row in packed.filter(F.col("block") == block).collect():
            found = stored(phrase_matches(index, pickle.loads(row["payload"])), "hits")
            hits = found if blocks == 1 else hits.unionByName(found)
    if blocks > 1:
        hits = hits.groupBy("segment", "ordinal").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).mapInArrow(_united, HITS)
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "digests", "counts")).alias("ordinal", "d"))
    rows = rows.select("segment", F.col("ordinal").cast("long").alias("ordinal"), F.col("d.doc_ids").alias("doc_id"), F.col("d.digests").alias("digest"), F.col("d.counts").alias("n_words"))
    out = rows.join(hits, ["segment", "ordinal"], "left")
    return out.select("doc_id", "digest", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def proximity(documents: DataFrame, terms: list[list[str]], within: int = 8) -> DataFrame:
    """(query, doc_id, start): places where all terms of a query fall into `within` words.

    start is the rarest term's word offset in its document; order of terms is free.
    """
    index = build_index(documents)
    hashed = []
    for query in terms:
        data, offsets = text_bytes(pa.array(query, pa.string()))
        hashed.append(words(data, offsets, ALNUM)[0])
    sent = index.sparkSession.sparkContext.broadcast(hashed)
    schema = "query long, doc_id long, start long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                out: dict[str, list] = {"query": [], "doc_id": [], "start": []}
                for q, h in enumerate(sent.value):
                    ids = np.unique(seg.term_ids(h))
                    if not len(ids) or ids[0] < 0:
                        continue
                    lists = sorted((seg.postings[seg.heads[i] : seg.heads[i + 1]].astype(np.int64) for i in ids), key=len)
                    at, doc = lists[0], np.searchsorted(seg.starts, lists[0], "right") - 1
                    low, high = np.maximum(at - within + 1, seg.starts[doc]), np.minimum(at + within, seg.starts[doc + 1])
                    # every window of `within` words around the rarest term, tried in turn
                    ok = np.zeros(len(at), bool)
                    for shift in range(within):
                        a = np.maximum(at - shift, low)
                        b = np.minimum(a + within, high)
                        ok |= np.logical_and.reduce([np.searchsorted(x, a) < np.searchsorted(x, b) for x in lists])
                    for p, d in zip(at[ok].tolist(), doc[ok].tolist(), strict=True):
                        out["query"].append(q)
                        out["doc_id"].append(seg.doc_ids[d])
                        out["start"].append(p - int(seg.starts[d]))
                yield pa.RecordBatch.from_pydict(out, pa.schema([(k, pa.int64()) for k in out]))

    return index.mapInArrow(search, schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from decontaminate()'s spans and items."""
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM q),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.k, dw.n, q.item_id FROM dw JOIN q ON dw.n = q.n AND dw.g = q.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
