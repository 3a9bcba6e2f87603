"""Binary files as a source: listing, hashes and contents, pruned by name and length before they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators import packs, rules

MOST = 1 << 30  # bytes of a file that are read as one value; Spark's own limit is 2 GB


def binaries(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder; contents are read only where they are selected.

    Empty files are not listed: Spark's file readers skip them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def named(suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.lower("path").endswith(s)
    return out


def file_hashes(spark: SparkSession, path: str, suffixes: tuple[str, ...] = packs.MODEL_SUFFIXES, most: int = MOST) -> DataFrame:
    """(path, length, hash): SHA-256 of files by suffix; a file over `most` bytes is listed with a null hash, unread."""
    files = binaries(spark, path).filter(named(suffixes))
    small = files.filter(F.col("length") <= most).select("path", "length", F.sha2("content", 256).alias("hash"))
    return small.unionByName(files.filter(F.col("length") > most).select("path", "length", F.lit(None).cast("string").alias("hash")))


def changed_models(spark: SparkSession, path: str, host: str, baseline: DataFrame) -> DataFrame:
    """ai_integrity() over the files of a folder; baseline: host, path, hash."""
    return rules.ai_integrity(file_hashes(spark, path).withColumn("host", F.lit(host)), baseline)


def scanned(spark: SparkSession, path: str, glob: str = "*", most: int = MOST) -> DataFrame:
    """(path, length, rule): blob_scan() over the files of a folder; a file over `most` bytes has rule `too_long`."""
    files = binaries(spark, path, glob)
    hits = rules.blob_scan(files.filter(F.col("length") <= most).select("path", "length", "content"))
    return hits.unionByName(files.filter(F.col("length") > most).select("path", "length", F.lit("too_long").alias("rule")))
