"""Approximate nearest neighbours with randomly rotated one-bit codes.

A vector is scaled to length one, padded and turned by a random rotation (three rounds of
random signs and a Walsh-Hadamard transform, from a fixed seed, so there is no model to fit
or to send).  The signs of its coordinates are its code, packed; `fit`, the inner product of
the turned vector and its code, is its correction.  With a query turned the same way and cut
to PLANES bits a coordinate, popcounts give the inner product of query and code, and that
divided by `fit` is an unbiased estimate of the cosine, whose error is bounded by
EPSILON * sqrt((1 - fit^2) / fit^2 / (bits - 1) + what cutting the query adds) but for a chance
that falls with exp(-EPSILON^2).

All rows are scanned by their codes.  Only vectors whose estimate plus bound reaches the k-th
best cosine found so far are reranked, with the original vectors in double precision.  Tasks
return k rows a query at most; these are ranked in two steps.  Queries are sent in blocks of
QUERY_BYTES.

Cosines add up products in order of the coordinates, so equal vectors have equal scores.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows without vec_id, take no part; vectors of different lengths are not compared; repeated rows
are candidates, and queries, of their own (a query leaves out its own row alone); scores that
are equal go by vec_id; extra columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored
from .embedding_dedup import valid_vector

TOP = 5
EVERY = 50  # ids divisible by it are the queries of op12
BITS_MIN, BITS_A_DIMENSION = 256, 4  # of a code
PLANES = 6  # bits of a query's coordinate
EPSILON = 4.0
QUERY_BYTES = 32 << 20
ROWS, QUERIES = 1024, 512  # of a tile
SHARES = 64

INDEX = "row long, vec_id long, v array<double>, norm double, code binary, fit double"


def code_bits(d: int) -> int:
    """Bits of a code: a power of two."""
    return 1 << (max(BITS_MIN, BITS_A_DIMENSION * d) - 1).bit_length()


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows padded to code_bits() and turned."""
    n, d = x.shape
    bits = code_bits(d)
    y = np.zeros((n, bits))
    y[:, :d] = x
    rng = np.random.default_rng(bits)
    for _ in range(3):
        y *= rng.choice((-1.0, 1.0), bits)
        h = 1
        while h < bits:
            z = y.reshape(n, bits // (2 * h), 2, h)
            y = np.concatenate((z[:, :, :1] + z[:, :, 1:], z[:, :, :1] - z[:, :, 1:]), axis=2).reshape(n, bits)
            h *= 2
        y /= math.sqrt(bits)
    return y


def ordered_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first coordinate to the last."""
    return np.cumsum(x * y, axis=1)[:, -1]


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of these rows) for each length of a list column."""
    size = pc.list_value_length(column).to_numpy()
    flat, heads = column.flatten().to_numpy(), np.cumsum(size) - size
    for d in np.unique(size):
        some = np.flatnonzero(size == d)
        yield some, flat[heads[some][:, None] + np.arange(d)]


def build_index(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, v, norm, code, fit) of all valid vectors, stored; v is scaled by a power of two."""
    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & valid_vector("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                for some, v in _by_length(batch.column("v")):
                    v = np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])
                    norm = np.sqrt(ordered_dot(v, v))
                    turned = rotate(v / norm[:, None])
                    code = np.packbits(turned >= 0, axis=1, bitorder="little")
                    fit = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.reshape(-1)))
                    at = pa.array(some)
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("vec_id").take(at), lists, pa.array(norm), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(fit)], names=["row", "vec_id", "v", "norm", "code", "fit"])

    return stored(rows.mapInArrow(run, INDEX), "codes")


class Asked:
    """Queries of one length: vectors, bit planes of the turned vectors, and the k best of each so far."""

    def __init__(self, row: np.ndarray, v: np.ndarray, norm: np.ndarray, k: int) -> None:
        self.row, self.v, self.norm, self.k = row, v, norm, k
        turned = rotate(v / norm[:, None])
        self.bits = turned.shape[1]
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        whole = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.total = whole.sum(1, dtype=np.int64)
        self.planes = np.stack([np.packbits((whole >> p) & 1, axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)])
        self.query = np.zeros(0, np.int64)  # of each of the best: its query, cosine and id
        self.score, self.ids = np.zeros(0), np.zeros(0, np.int64)
        self.bar = np.full(len(row), -np.inf)
        self.reranked = 0

    def estimates(self, code: np.ndarray, fit: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, bounds) of the cosines of coded vectors and the queries lo to hi, from packed bits."""
        counts = np.zeros((len(code), hi - lo), np.int64)
        for p in range(PLANES):
            for w in range(code.shape[1]):
                counts += np.bitwise_count(code[:, w, None] & self.planes[p, lo:hi, w]).astype(np.int64) << p
        low, step, root = self.low[lo:hi], self.step[lo:hi], math.sqrt(self.bits)
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)[:, None]
        product = (2 * (low * ones + step * counts) - (low * self.bits + step * self.total[lo:hi])) / root
        spread = np.maximum(0, 1 - fit**2)[:, None] / (self.bits - 1) + step**2 / 12
        return product / fit[:, None], EPSILON * np.sqrt(spread) / fit[:, None]

    def rerank(self, own: np.ndarray, ids: np.ndarray, v: np.ndarray, norm: np.ndarray, row: np.ndarray, query: np.ndarray) -> None:
        """Cosines of (row, query) pairs; the k best of each query stay."""
        apart = own[row] != self.row[query]
        row, query = row[apart], query[apart]
        self.reranked += len(row)
        score = np.empty(len(row))
        for lo in range(0, len(row), 4096):
            a, b = row[lo : lo + 4096], query[lo : lo + 4096]
            score[lo : lo + 4096] = ordered_dot(v[a], self.v[b]) / (norm[a] * self.norm[b])
        query, score, ids = np.concatenate((self.query, query)), np.concatenate((self.score, score)), np.concatenate((self.ids, ids[row]))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, place = order[place < self.k], query[place < self.k], place[place < self.k]
        self.query, self.score, self.ids = query, score[order], ids[order]
        last = place == self.k - 1
        self.bar[query[last]] = self.score[last]

    def scan(self, own: np.ndarray, ids: np.ndarray, v: np.ndarray, norm: np.ndarray, code: np.ndarray, fit: np.ndarray) -> None:
        """All queries against a tile of indexed vectors of the same length."""
        for lo in range(0, len(self.row), QUERIES):
            hi = min(len(self.row), lo + QUERIES)
            estimate, bound = self.estimates(code, fit, lo, hi)
            upper = estimate + bound
            done = np.zeros(upper.shape, bool)
            new = lo + np.flatnonzero(self.bar[lo:hi] == -np.inf)
            if len(new):  # a first bar from the best estimates
                most = min(self.k + 1, len(own))
                first = np.argpartition(-estimate[:, new - lo], most - 1, axis=0)[:most]
                done[first, new - lo] = True
                self.rerank(own, ids, v, norm, first.reshape(-1), np.tile(new, most))
            row, query = np.nonzero((upper >= self.bar[lo:hi]) & ~done)
            self.rerank(own, ids, v, norm, row, query + lo)


def _search(sent, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {v.shape[1]: Asked(row, v, norm, k) for row, v, norm in sent.value}
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                own, ids, norm, fit = (batch.column(c).to_numpy() for c in ("row", "vec_id", "norm", "fit"))
                code = batch.column("code").to_pylist()
                for some, v in _by_length(batch.column("v")):
                    if v.shape[1] in asked:
                        packed = np.frombuffer(b"".join(code[i] for i in some), np.uint64).reshape(len(some), -1)
                        asked[v.shape[1]].scan(own[some], ids[some], v, norm[some], packed, fit[some])
        for a in asked.values():
            yield pa.RecordBatch.from_arrays([pa.array(a.row[a.query], pa.int64()), pa.array(a.ids, pa.int64()), pa.array(a.score)], names=["query", "vec_id", "score"])

    return run


def search(embeddings: DataFrame, wanted: str, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all rows for each row that the condition `wanted` names."""
    index = build_index(embeddings)
    spark = embeddings.sparkSession
    queries = stored(index.filter(wanted).select("row", "vec_id", "v", "norm"), "queries")
    volume = queries.agg(F.sum(F.size("v") * 8).alias("n")).first()["n"] or 0
    blocks = math.ceil(volume / QUERY_BYTES)
    out = spark.createDataFrame([], "query long, vec_id long, score double")
    for block in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).toArrow()
        columns = {c: rows.column(c).combine_chunks() for c in ("row", "v", "norm")}
        if not rows.num_rows:
            continue
        sent = spark.sparkContext.broadcast([(columns["row"].to_numpy()[some], v, columns["norm"].to_numpy()[some]) for some, v in _by_length(columns["v"])])
        found = stored(index.mapInArrow(_search(sent, k), out.schema), "nearest")
        out = found if blocks == 1 else out.unionByName(found)
    order = (F.desc("score"), "vec_id")
    share = Window.partitionBy("query", F.pmod(F.xxhash64("vec_id"), F.lit(SHARES))).orderBy(*order)
    few = out.withColumn("place", F.row_number().over(share)).filter(F.col("place") <= k).drop("place")
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    return best.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")


def op12_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), f"vec_id % {EVERY} = 0")


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT *, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.norm * c.norm) AS score
    FROM n q JOIN n c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0 AND q.norm > 0 AND c.norm > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
