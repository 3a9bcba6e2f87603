"""Merkle fixity audit of web archives.

Records of an archive file are hashed, and nodes over ordered offset ranges are hashed
from their children, FANOUT at a time: slots of a file, files, groups of files, up to one
root.  Two replicas are compared at the root; only the children of nodes that differ are
compared next, so what is compared follows the damage, not the archive.  The levels'
tables are partitioned by the children of the root, and partitions without damage are
not read.

A record's place in its file (slot) comes from its id, not from its offset, so a lost
record does not shift the places of those behind it.

Defined cases: null url or body is empty; several records of one slot are hashed as a
multiset, by sums over their digests, so any number of them is combined before a shuffle;
a record that only one replica holds is `missing` (from b) or `extra` (in b); a null id
goes to file -1, slot 0, beside the root of all others; empty replicas give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

FANOUT = 16
FILE_LEVELS = 2  # of a file's own tree
SLOTS = FANOUT**FILE_LEVELS


def warc_records(pages: DataFrame, body: F.Column | None = None) -> DataFrame:
    """(file, slot, page_id, digest, length) of the WARC response record of each page."""
    body = F.coalesce(F.col("html") if body is None else body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    record = F.concat(head, body, F.lit("\r\n\r\n"))
    return pages.select(
        F.coalesce(F.floor(F.col("page_id") / SLOTS), F.lit(-1)).cast("long").alias("file"),
        F.coalesce(F.pmod("page_id", F.lit(SLOTS)), F.lit(0)).cast("long").alias("slot"),
        F.col("page_id").cast("long").alias("page_id"),
        F.sha2(record.cast("binary"), 256).alias("digest"),
        F.octet_length(record).cast("long").alias("length"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """One row per file and slot (node = file * SLOTS + slot): hash of its records, and their offset range."""
    parts = [F.sum(F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"p{i}") for i in range(8)]
    slot = records.groupBy("file", "slot").agg(F.count("*").alias("n"), *parts, F.min("page_id").alias("page_id"), F.sum("length").alias("length"))
    text = F.concat_ws(":", "n", *[f"p{i}" for i in range(8)])
    before = Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))
    return slot.select((F.col("file") * SLOTS + F.col("slot")).alias("node"), F.sha2(text.cast("binary"), 256).alias("hash"), "page_id", offset.alias("offset"), "length")


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: nodes hashed from at most FANOUT children, in order."""
    child = F.array_sort(F.collect_list(F.struct("node", "hash", "length")))
    up = nodes.groupBy(F.floor(F.col("node") / FANOUT).alias("up")).agg(child.alias("c"), F.min("offset").alias("offset"), F.sum("length").alias("length"))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"], x["length"].cast("string"))), "|")
    return up.select(F.col("up").alias("node"), F.sha2(text.cast("binary"), 256).alias("hash"), "offset", "length")


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of the tree, leaves first, the root last; each is stored by the root's children (`part`)."""
    out: list[DataFrame] = []
    for level in range(levels + 1):
        nodes = parents(out[-1].drop("part")) if out else leaves(records)
        part = F.floor(F.col("node") / FANOUT ** max(0, levels - 1 - level))
        if level < levels - 1:  # ranges of nodes, so that a task writes few partitions
            nodes = nodes.repartitionByRange("node").withColumn("part", part)
            out.append(stored(nodes, "tree", "part"))
        else:
            out.append(stored(nodes, "tree"))
    return out


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, slot, page_id, status, offset, length, offset_b, length_b) of each record place that differs."""
    last = a.select("file").union(b.select("file")).agg(F.max("file")).first()[0]
    levels = FILE_LEVELS
    while last is not None and last > 0:
        last, levels = last // FANOUT, levels + 1
    left, right = (tree(x, levels) for x in (a, b))
    wrong = damaged = None
    for level in range(levels, -1, -1):
        sides = []
        for nodes in (left[level], right[level]):
            if "part" in nodes.columns:
                # at most FANOUT children of the root, and those beside it
                damaged = [r["up"] for r in wrong.collect()] if damaged is None else damaged
                nodes = nodes.filter(F.col("part").isin(damaged)).drop("part")
            sides.append(nodes if wrong is None else nodes.withColumn("up", F.floor(F.col("node") / FANOUT)).join(wrong, "up", "left_semi").drop("up"))
        x, y = sides[0], sides[1].select("node", *[F.col(c).alias(f"{c}_b") for c in sides[1].columns if c != "node"])
        differ = x.join(y, "node", "full").filter(~F.col("hash").eqNullSafe(F.col("hash_b")))
        if level:
            wrong = stored(differ.select(F.col("node").alias("up")), "wrong")
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    file, slot = F.floor(F.col("node") / SLOTS).alias("file"), F.pmod("node", F.lit(SLOTS)).alias("slot")
    return differ.select(file, slot, F.coalesce("page_id", "page_id_b").alias("page_id"), status.alias("status"), "offset", "length", "offset_b", "length_b")


def op9_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the archive of all pages against a replica with damage by a fixed rule: one page in
    256 (by hash) has a byte too many, another one is lost."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    damaged = F.when(mark == "00", F.concat(F.coalesce("html", F.lit("")), F.lit("."))).otherwise(F.col("html"))
    return audit(warc_records(pages), warc_records(pages.filter(mark != "01"), damaged))


ORACLE_SQL = f"""
WITH m AS (SELECT page_id, substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS m,
    CAST(floor(page_id / {SLOTS}.0) AS BIGINT) AS file, page_id % {SLOTS} AS slot, coalesce(html, '') AS body, coalesce(url, '') AS url FROM pages),
r AS (SELECT *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' AS head FROM m),
a AS (SELECT file, slot, page_id, m, strlen(head) + length(CAST(strlen(body) AS VARCHAR)) + 8 + strlen(body) AS length FROM r),
b AS (SELECT file, slot, page_id, m, strlen(head) + length(CAST(strlen(body) + (m = '00')::INT AS VARCHAR)) + 8 + strlen(body) + (m = '00')::INT AS length FROM r WHERE m <> '01'),
ao AS (SELECT *, sum(length) OVER (PARTITION BY file ORDER BY slot) - length AS "offset" FROM a),
bo AS (SELECT *, sum(length) OVER (PARTITION BY file ORDER BY slot) - length AS "offset" FROM b)
SELECT ao.file, ao.slot, ao.page_id, CASE WHEN ao.m = '01' THEN 'missing' ELSE 'changed' END AS status,
    CAST(ao."offset" AS BIGINT) AS "offset", CAST(ao.length AS BIGINT) AS length, CAST(bo."offset" AS BIGINT) AS offset_b, CAST(bo.length AS BIGINT) AS length_b
FROM ao LEFT JOIN bo USING (page_id) WHERE ao.m IN ('00', '01')
"""
