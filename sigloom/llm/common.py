"""Shared helpers: shared-folder tables, and vectorised word hashing over Arrow text.

Every helper works on whole texts.  Arrow batches are cut into slices of a few
megabytes so that a task's memory follows the slice, not the partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xC2B2AE3D27D4EB4F | 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one below the warehouse where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found.rstrip("/") if found else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: its cleaner runs when the driver
    collects garbage, so that disk follows the largest step and not the sum of all."""
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write df as a table in the shared folder, partitioned by parts, and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply), in place on a fresh array."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = (max(n, SLICE_BYTES) // (1 << 20) + 1) << 20
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            out.append(p)
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def prefix_sums(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """Polynomial prefix sums: a range hash is (S[j]-S[i]) * base**-i."""
    p, _ = powers(base, len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=s[1:])
    return s


def range_hash(s: np.ndarray, i: np.ndarray, j: np.ndarray, base: int = BASE) -> np.ndarray:
    _, inv = powers(base, len(s))
    return mix((s[j] - s[i]) * inv[i])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and n+1 offsets; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by text volume; a longer single text stands alone."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = text_bytes(batch.column(column))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACED = np.ones(256, bool)  # word bytes of [^\x20\x09-\x0D]+
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)  # word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts: hash, start, end (bytes), and word offsets per text."""
    low = LOWER[data]
    inside = kind[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    first = inside & (~before | edge[:-1])
    after = np.concatenate((inside[1:], [False]))
    last = inside & (~after | edge[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    s = prefix_sums(low)
    h = range_hash(s, start, end)
    return h, start, end, np.searchsorted(start, offsets)
