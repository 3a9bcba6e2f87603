r"""Ranked lexical search over impact lists with the Best Position Algorithm.

The index is a table of segments.  A segment covers whole documents (SEGMENT_BYTES of text)
and has, for each term, its impact list: the documents that hold the term, by falling
impact.  Terms are kept as bytes and compared as such; nothing rests on hashes.

A query goes down the lists of its terms side by side.  A document that turns up is looked
up in all lists at once (direct access), which gives its score and its places in the lists.
A list's best position is the end of the run of places seen from its head on, be it by
sorted or by direct access; no unseen document can score more than the sum of the impacts at
the best positions, and the search of a segment stops when that sum is strictly below the
k-th score found.  A task carries its best k from segment to segment, so later segments stop
earlier.  Each task returns k rows a query at most, and these are ranked in two steps, first
within shares of a query's rows.

Impacts are integers as scores are, so the ranking is exact: N, L come from a pass over all
documents before the index is built, and document frequencies from the lists' lengths.
Queries are sent in blocks of QUERY_TERMS terms; a block's vocabulary is what the driver sees.

Memory: a task holds one segment, that is SEGMENT_BYTES of text or one longer text, at some
10 bytes a byte of it.

Defined cases: a null or empty text has no terms and counts in no statistic; repeated rows are
documents of their own; a null doc_id ranks behind others of the same score; rows that share an
item_id (null is one, too) are one query with the terms of all; a query without terms, or none
of whose terms occurs, has no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, slices, stored, text_bytes

TOP = 10
SEGMENT_BYTES = 16 << 20
QUERY_TERMS = 2_000_000  # (query, term) pairs sent at once
STEP = 64  # rows of each list in the first round of sorted accesses; later rounds double
DENSE = 16  # a list with a document in so many, or more, has its places in an array
SHARES = 64
IMPACT_BITS = 20  # an impact is below 1,000,000

INDEX = "segment long, doc_ids array<long>, terms binary, ends binary, heads binary, docs binary, impacts binary"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts: their bytes one behind the other, the start of each word in these, words of each text."""
    low = LOWER[data]
    inside = ALNUM[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(low)]
    first[heads] = inside[heads]
    counts = np.diff(np.searchsorted(np.flatnonzero(first), offsets))
    return low[inside], np.flatnonzero(first[inside]), counts


def binary_array(flat: np.ndarray, starts: np.ndarray) -> pa.LargeBinaryArray:
    ends = np.append(starts, len(flat)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def statistics(documents: DataFrame) -> tuple[int, int]:
    """(N, L): documents with a term, and all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for batch in batches:
            for part in slices(batch):
                counts = tokens(*text_bytes(part.column("text")))[2]
                n, terms = n + int((counts > 0).sum()), terms + int(counts.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "terms": [terms]}, pa.schema([("n", pa.int64()), ("terms", pa.int64())]))

    row = documents.select("text").mapInArrow(run, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    return row["n"] or 0, row["terms"] or 0


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A term's impact in a document of n terms in which it occurs tf times."""
    m = 10 + (90 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _segment(number: int, ids: list, flat: list[np.ndarray], starts: list[np.ndarray], counts: np.ndarray, documents: int, terms: int) -> pa.RecordBatch:
    shift = np.cumsum([0] + [len(x) for x in flat[:-1]])
    words = binary_array(np.concatenate(flat), np.concatenate([s + k for s, k in zip(starts, shift, strict=True)])).dictionary_encode()
    vocabulary, size = words.dictionary, len(ids)
    key = words.indices.to_numpy().astype(np.int64)
    key *= size
    key += np.repeat(np.arange(size), counts)
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // max(1, size), key % max(1, size)
    weight = impact(tf, counts[doc], documents, terms)
    order = np.argsort((term << IMPACT_BITS) + ((1 << IMPACT_BITS) - 1 - weight), kind="stable")
    heads = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(vocabulary)))))
    ends = np.frombuffer(vocabulary.buffers()[1], np.int64, len(vocabulary) + 1, vocabulary.offset * 8)
    blob = vocabulary.buffers()[2].to_pybytes()[: int(ends[-1])] if len(vocabulary) else b""
    pack = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([blob], pa.binary()), pack(ends, np.int64), pack(heads, np.int64), pack(doc[order], np.int32), pack(weight[order], np.int32)]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "doc_ids", "terms", "ends", "heads", "docs", "impacts"])


def _segments(least: int, documents: int, terms: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, flat, starts, counts, size = [], [], [], [], 0
        for batch in batches:
            for part in slices(batch, limit=min(1 << 20, least)):
                data, offsets = text_bytes(part.column("text"))
                f, s, c = tokens(data, offsets)
                has = c > 0  # documents without terms are in no list
                ids += pc.filter(part.column("doc_id"), pa.array(has)).to_pylist()
                flat.append(f)
                starts.append(s)
                counts.append(c[has])
                size += len(data)
                if size >= least and ids:
                    yield _segment(number, ids, flat, starts, np.concatenate(counts), documents, terms)
                    number += 1
                    ids, flat, starts, counts, size = [], [], [], [], 0
        if ids:
            yield _segment(number, ids, flat, starts, np.concatenate(counts), documents, terms)

    return run


def build_index(documents: DataFrame) -> tuple[DataFrame, int]:
    """(impact lists of all documents, stored in the shared folder; number of documents with terms)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, terms = statistics(rows)
    return stored(rows.mapInArrow(_segments(SEGMENT_BYTES, n, terms), INDEX), "impacts"), n


class Segment:
    """One segment's impact lists of the terms of a vocabulary."""

    def __init__(self, row: dict, vocabulary: pa.LargeBinaryArray) -> None:
        ids = row["doc_ids"]
        self.null = np.array([x is None for x in ids], bool)
        self.ids = np.array([0 if x is None else x for x in ids], np.int64)
        ends = np.frombuffer(row["ends"], np.int64)
        terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(row["ends"]), pa.py_buffer(row["terms"])])
        self.at = pc.fill_null(pc.index_in(vocabulary, value_set=terms), -1).to_numpy()
        self.heads, self.docs, self.impacts = np.frombuffer(row["heads"], np.int64), np.frombuffer(row["docs"], np.int32), np.frombuffer(row["impacts"], np.int32)
        self.places: dict[int, tuple] = {}

    def sizes(self) -> np.ndarray:
        """Length of each vocabulary term's list."""
        return np.where(self.at >= 0, np.diff(self.heads)[self.at], 0)

    def impact_list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.heads[self.at[term]], self.heads[self.at[term] + 1]
        return self.docs[lo:hi], self.impacts[lo:hi]

    def direct(self, term: int, docs: np.ndarray) -> np.ndarray:
        """Place of each document in a term's list, -1 where it is not in it."""
        if term not in self.places:
            listed = self.impact_list(term)[0]
            if len(listed) * DENSE >= len(self.ids):
                place = np.full(len(self.ids), -1, np.int32)
                place[listed] = np.arange(len(listed), dtype=np.int32)
                self.places[term] = (None, place)
            else:
                order = np.argsort(listed).astype(np.int32)
                self.places[term] = (listed[order], order)
        ascending, place = self.places[term]
        if ascending is None:
            return place[docs]
        at = np.minimum(np.searchsorted(ascending, docs), len(ascending) - 1)
        return np.where(ascending[at] == docs, place[at], -1)


@dataclass
class Best:
    """The k best documents so far: scores, ids and whether an id is null, best first."""

    k: int
    score: np.ndarray
    ids: np.ndarray
    null: np.ndarray

    @staticmethod
    def none(k: int) -> Best:
        return Best(k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def bar(self) -> int:
        """The k-th score, or 0 where there are fewer."""
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        some = score >= max(1, self.bar())
        score, ids, null = (np.concatenate((a, b[some])) for a, b in ((self.score, score), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]


def best_positions(segment: Segment, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Put a segment's documents that are among the best into `best`; returns how deep the lists were read."""
    some = (segment.at[terms] >= 0) & (weights > 0)
    terms, weights = terms[some].tolist(), weights[some].tolist()
    lists = [segment.impact_list(t) for t in terms]
    position = [0] * len(lists)  # places before it are all seen
    seen = np.zeros(len(segment.ids), bool)
    depth, step, longest = 0, STEP, max((len(d) for d, _ in lists), default=0)
    while depth < longest:
        docs = np.unique(np.concatenate([d[depth : depth + step] for d, _ in lists]))
        docs = docs[~seen[docs]]
        depth, step = depth + step, step * 2
        if len(docs):
            seen[docs] = True
            score = np.zeros(len(docs), np.int64)
            for t, w, (_, impacts) in zip(terms, weights, lists, strict=True):
                place = segment.direct(t, docs)
                in_list = place >= 0
                score[in_list] += w * impacts[place[in_list]].astype(np.int64)
            best.add(score, segment.ids[docs], segment.null[docs])
        threshold = 0
        for i, (listed, impacts) in enumerate(lists):
            at = max(position[i], min(depth, len(listed)))
            while at < len(listed):  # the run of seen places goes on by direct accesses
                ahead = seen[listed[at : at + 256]]
                run = len(ahead) if ahead.all() else int(ahead.argmin())
                at += run
                if run < len(ahead):
                    break
            position[i] = at
            threshold += weights[i] * int(impacts[at - 1]) if at < len(listed) else 0
        if threshold < best.bar():
            break
    return depth


@dataclass
class Queries:
    """A block of queries: its vocabulary, and each query's terms as numbers into it."""

    items: list
    terms: list[np.ndarray]
    vocabulary: pa.LargeBinaryArray


def query_blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    """(block, item_id, terms) of each query, stored, and the number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat, starts, counts = tokens(*text_bytes(part.column("text")))
                items = part.column("item_id").take(pa.array(np.repeat(np.arange(part.num_rows), counts)))
                yield pa.RecordBatch.from_arrays([items, binary_array(flat, starts).cast(pa.binary())], names=["item_id", "term"])

    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    pairs = stored(rows.mapInArrow(run, "item_id long, term binary").distinct(), "query-terms")
    blocks = math.ceil(pairs.count() / QUERY_TERMS)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))).alias("block")
    return stored(pairs.groupBy("item_id").agg(F.collect_list("term").alias("terms")).select(block, "item_id", "terms"), "queries"), blocks


def _block(rows: list) -> Queries:
    flat = pa.array([t for r in rows for t in r["terms"]], pa.large_binary())
    coded = flat.dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int64)
    cut = np.cumsum([len(r["terms"]) for r in rows])[:-1]
    return Queries([r["item_id"] for r in rows], np.split(numbers, cut), coded.dictionary)


def document_frequencies(index: DataFrame, queries: Queries) -> np.ndarray:
    """Documents that hold each term of a block's vocabulary."""
    sent = index.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                total += Segment(row, sent.value).sizes()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    lists = index.withColumns({"docs": F.lit(b""), "impacts": F.lit(b"")})  # lengths need no postings
    found = lists.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(queries.vocabulary), np.int64)
    for r in found:
        out[r["term"]] = r["n"]
    return out


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, ranked: first within shares of them, so that no item meets in one task."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    place = F.row_number().over(Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SHARES))).orderBy(*order))
    few = rows.withColumn("place", place).filter(F.col("place") <= k).drop("place")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return few.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(documents: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents for each query (item_id, text), by falling score, then doc_id."""
    index, n = build_index(documents)
    blocks, many = query_blocks(queries)
    spark = documents.sparkSession
    schema = "item_id long, doc_id long, score long"
    out = spark.createDataFrame([], schema)
    for block in range(many):
        asked = _block(blocks.filter(F.col("block") == block).collect())
        if not asked.items:
            continue
        df = document_frequencies(index, asked)
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        sent = spark.sparkContext.broadcast((asked, weights))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            asked, weights = sent.value
            best = [Best.none(k) for _ in asked.items]
            for batch in batches:
                for row in batch.to_pylist():
                    segment = Segment(row, asked.vocabulary)
                    for own, terms in zip(best, asked.terms, strict=True):
                        best_positions(segment, terms, weights[terms], own)
            sizes = [len(b.score) for b in best]
            items = pa.array([x for x, size in zip(asked.items, sizes, strict=True) for _ in range(size)], pa.int64())
            ids, null, score = (np.concatenate([getattr(b, c) for b in best]) for c in ("ids", "null", "score"))
            yield pa.RecordBatch.from_arrays([items, pa.array(ids, pa.int64(), mask=null), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

        found = stored(index.mapInArrow(run, schema), "ranked")
        out = found if many == 1 else out.unionByName(found)
    return ranked(out, k)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH t AS (SELECT d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)),
tf AS (SELECT d, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
lengths AS (SELECT d, sum(tf) AS n FROM tf GROUP BY d),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
df AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS w FROM tf, s GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT q.item_id, tf.doc_id, tf.d, sum(CAST(w AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * CAST(n AS BIGINT) * docs) // words)))) AS score
    FROM q JOIN df USING (term) JOIN tf USING (term) JOIN lengths USING (d), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
