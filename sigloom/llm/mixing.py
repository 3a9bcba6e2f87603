"""Mixing sources to target weights with Pfair scheduling.

A source's documents form blocks of `block` documents.  With target weight w (in
slots out of PERIOD), block k of a source may not be served before floor(k*P/w) and
has to be served before ceil((k+1)*P/w).  Earliest deadline first over these windows
serves one block a slot, so at every slot each source is within one block of its
target.  The pattern repeats after P slots: it is computed once, as a table of
P rows, and a block's slot follows from its number by a join.  P is PERIOD up to
PERIOD sources; with more sources it grows with their number, see slots().

A source that runs out leaves its slots empty; order by slot stays the mix of the
others at their relative weights.  Nothing is dropped or repeated.

Defined cases: a null source is a source of its own; repeated rows are numbered each;
ties in the hash order go by doc_id; an empty table gives an empty result; a weight of
0 or an unlisted source is an error; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PERIOD = 240
BLOCK_DOCS = 8
SLOTS_A_SOURCE = 4
BROADCAST_SLOTS = 100_000
CHUNK = 512
BUCKETS = 4096
RESULT = ("weight", "block", "block_release", "block_deadline", "slot")


def slots(sources: int, period: int = PERIOD) -> int:
    """Slots before the pattern of so many sources repeats: the period, or where it has no slot for
    each of them, the multiple of it that has SLOTS_A_SOURCE for each."""
    return period if sources <= period else period * -(-SLOTS_A_SOURCE * sources // period)


def default_weights(documents: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, weight) in slots of the period: proportional to the square root of the source's
    size, rounded down but at least 1; the rest goes to the largest sources in turn.

    Where the minimum of 1 overshoots the period, the largest source pays; if it cannot, the
    largest sources go down to a common level.  The period has a slot for each source, see slots().
    """
    sizes = documents.groupBy("source").agg(F.count("*").alias("n"))
    everywhere = Window.partitionBy()
    by_size = everywhere.orderBy(F.desc("n"), F.asc_nulls_first("source"))
    share = F.sqrt("n") / F.sum(F.sqrt("n")).over(everywhere)
    low = sizes.withColumn("low", F.greatest(F.lit(1), F.floor(share * period)).cast("long"))
    low = low.withColumn("left", F.lit(period) - F.sum("low").over(everywhere)).withColumn("rank", F.row_number().over(by_size) - 1).withColumn("m", F.count("*").over(everywhere))
    extra = F.floor(F.col("left") / F.col("m")) + (F.col("rank") < F.pmod("left", "m")).cast("long")
    # what lowering all larger sources to this one's slots would free; those where that is too little go down
    freed = F.sum("low").over(by_size.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("rank") + 1) * F.col("low")
    low = low.withColumn("top", F.max("low").over(everywhere)).withColumn("down", freed <= -F.col("left"))
    low = low.withColumn("payers", F.sum(F.col("down").cast("long")).over(everywhere)).withColumn("keep", F.sum(F.when(F.col("down"), F.col("low"))).over(everywhere) + F.col("left"))
    level = F.floor(F.col("keep") / F.col("payers")) + (F.col("rank") < F.col("keep") % F.col("payers")).cast("long")
    one = F.col("low") + F.when(F.col("rank") == 0, F.col("left")).otherwise(0)
    weight = F.when(F.col("left") >= 0, F.col("low") + extra).when(F.col("top") + F.col("left") >= 1, one).when(F.col("down"), level).otherwise(F.col("low"))
    return low.select("source", weight.cast("long").alias("weight"))


def pattern(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, weight, k, slot): which source's k-th block each slot of the period serves.

    Sources of equal weight have equal windows and are served in turn, so they form a class
    that is a queue.  A fold over the slots inside one row has as state the number of blocks
    served of each class: there are at most sqrt(2 * period) weights.  The slots are taken
    in chunks, so that a step appends to a short list.
    """
    names = [F.coalesce("source", F.lit("")), F.col("source").isNull()]
    sources = weights.select("source", F.col("weight").cast("long").alias("weight"))
    sources = sources.withColumn("i", F.row_number().over(Window.partitionBy().orderBy(*names, "weight")))
    sources = sources.withColumn("j", F.row_number().over(Window.partitionBy("weight").orderBy("i")).cast("long") - 1)
    w = sources.groupBy("weight").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("i")).alias("members"))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["weight"] * x["n"])
    w = w.agg(F.array_sort(F.collect_list(F.struct("weight", "n", "members"))).alias("w")).filter(F.size("w") > 0)
    bad = F.exists("w", lambda x: x["weight"].isNull() | (x["weight"] < 1)) | (total != period)
    w = w.withColumn("w", F.when(bad, F.raise_error(F.lit(f"weights must be 1 or more and sum to {period}"))).otherwise(F.col("w")))
    w = w.select(F.transform("w", lambda x, c: F.struct(c.alias("c"), x["weight"].alias("weight"), x["n"].alias("n"), x["members"].alias("members"))).alias("w"))
    let = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  value is computed once

    def head(x, served):
        # the next block of the class: by deadline, then by source
        k, j = F.floor(served / x["n"]), served % x["n"]
        return k, F.struct(F.ceil((k + 1) * period / x["weight"]).alias("deadline"), F.element_at(x["members"], (j + 1).cast("int")).alias("i"), x["c"].alias("c"), x["weight"].alias("weight"), j.alias("j"), k.alias("k"))

    def ready(x, served, t):
        k, block = head(x, served)
        return F.when(F.floor(k * period / x["weight"]) <= t, block)

    def serve(state, t):
        first = F.array_min(F.zip_with("w", state["served"], lambda x, n: ready(x, n, t)))
        pick = lambda p: F.array(F.struct(p["weight"].alias("weight"), p["j"].alias("j"), p["k"].alias("k"), t.cast("long").alias("slot")))
        return let(first, lambda p: F.struct(F.transform(state["served"], lambda n, c: F.when(c == p["c"], n + 1).otherwise(n)).alias("served"), F.concat(state["picks"], pick(p)).alias("picks")))

    def chunk(state, t):
        slots_of = F.sequence(t, F.least(t + CHUNK, F.lit(period)) - 1)
        start = F.struct(state["served"].alias("served"), F.array().cast("array<struct<weight:bigint,j:bigint,k:bigint,slot:bigint>>").alias("picks"))
        return let(F.aggregate(slots_of, start, serve), lambda r: F.struct(r["served"].alias("served"), F.concat(state["chunks"], F.array(r["picks"])).alias("chunks")))

    start = F.struct(F.transform("w", lambda _: F.lit(0).cast("long")).alias("served"), F.array().cast("array<array<struct<weight:bigint,j:bigint,k:bigint,slot:bigint>>>").alias("chunks"))
    chunks = F.aggregate(F.sequence(F.lit(0), F.lit(period - 1), F.lit(CHUNK)), start, chunk, lambda r: r["chunks"])
    picks = w.select(F.explode(chunks).alias("chunk")).select(F.explode("chunk").alias("p")).select("p.*")
    return picks.join(sources.drop("i"), ["weight", "j"]).select("source", "weight", "k", "slot")


def mix(documents: DataFrame, weights: DataFrame | None = None, period: int = PERIOD, block: int = BLOCK_DOCS) -> DataFrame:
    """documents with weight, block (number within the source), block_release, block_deadline and slot.

    A source's documents are numbered in hash order: counts of hash buckets give each bucket's
    first number, so a hot source is numbered by BUCKETS tasks' worth of windows, not by one.
    """
    given = documents.drop(*RESULT)
    key = F.md5(F.col("doc_id").cast("string"))
    placed = given.select("*", F.coalesce(key, F.lit("")).alias("__hash"), F.coalesce(F.col("source"), F.lit("")).alias("__name"), F.col("source").isNull().alias("__none"))
    placed = placed.withColumn("__bucket", F.conv(F.substring("__hash", 1, 3), 16, 10).cast("int"))
    place = ["__name", "__none", "__bucket"]
    counts = documents.select(F.coalesce("source", F.lit("")).alias("__name"), F.col("source").isNull().alias("__none"), F.conv(F.substring(F.coalesce(key, F.lit("")), 1, 3), 16, 10).cast("int").alias("__bucket"))
    counts = counts.groupBy(*place).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__name", "__none").orderBy(F.asc_nulls_first("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long"))).drop("__n")
    counts = counts.withColumn("__bucket", F.coalesce("__bucket", F.lit(-1)))
    placed = placed.withColumn("__bucket", F.coalesce("__bucket", F.lit(-1)))
    order = Window.partitionBy(*place).orderBy("__hash", F.asc_nulls_first("doc_id"))
    if weights is None:
        period = slots(documents.select("source").distinct().count(), period)
        weights = default_weights(documents, period)
    source = [F.coalesce("source", F.lit("")).alias("__name"), F.col("source").isNull().alias("__none")]
    served = pattern(weights, period).select(*source, F.col("k").alias("__k"), F.col("slot").alias("__slot"))
    # both have a row a slot or a source; a table too large to send is joined by shuffle
    small = F.broadcast if period <= BROADCAST_SLOTS else lambda df: df
    counts = counts.join(small(weights.select(*source, F.col("weight").cast("long").alias("weight"))), ["__name", "__none"], "left")
    unlisted = F.raise_error(F.concat(F.lit("no weight for source "), F.when(F.col("__none"), "null").otherwise(F.col("__name"))))
    counts = counts.withColumn("weight", F.when(F.col("weight").isNull(), unlisted).otherwise(F.col("weight")))
    numbered = placed.withColumn("__i", F.row_number().over(order) - 1).join(counts, place)
    numbered = numbered.withColumn("block", F.floor((F.col("__first") + F.col("__i")) / block))
    numbered = numbered.withColumn("__k", F.col("block") % F.col("weight"))
    out = numbered.join(small(served), ["__name", "__none", "__k"])
    turn = F.floor(F.col("block") / F.col("weight")) * period
    return out.select(
        *[F.col(f"`{c}`") for c in given.columns],
        "weight",
        "block",
        F.floor(F.col("block") * period / F.col("weight")).alias("block_release"),
        F.ceil((F.col("block") + 1) * period / F.col("weight")).alias("block_deadline"),
        (turn + F.col("__slot")).alias("slot"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs)


def oracle_sql(documents: str = "documents", period: int = PERIOD, block: int = BLOCK_DOCS, columns: str = "doc_id, source") -> str:
    return f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM {documents} GROUP BY source),
low AS (SELECT source, n, CAST(greatest(1, floor(sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes) * {period})) AS BIGINT) AS low,
    row_number() OVER (ORDER BY n DESC, source NULLS FIRST) - 1 AS rank FROM sizes),
spare AS (SELECT *, CAST({period} - (SELECT sum(low) FROM low) AS BIGINT) AS spare, (SELECT count(*) FROM low) AS m FROM low),
weights AS (SELECT source, CAST(low + CASE WHEN spare > 0 THEN spare // m + CAST(rank < spare % m AS BIGINT) WHEN rank = 0 THEN spare ELSE 0 END AS BIGINT) AS weight FROM spare),
w AS (SELECT source, weight, CAST(row_number() OVER (ORDER BY coalesce(source, ''), source IS NULL, weight) AS INT) AS i FROM weights),
e AS (SELECT CAST(-1 AS BIGINT) AS slot, 0 AS pick, CAST(0 AS BIGINT) AS k, list_transform(range((SELECT count(*) FROM w)), lambda x: CAST(0 AS BIGINT)) AS served
    UNION ALL
    SELECT slot + 1, p, served[p], list_transform(served, lambda c, i: CASE WHEN i = p THEN c + 1 ELSE c END)
    FROM (SELECT e.slot, e.served, (SELECT w.i FROM w WHERE e.served[w.i] * {period} // w.weight <= e.slot + 1
        ORDER BY -((-(e.served[w.i] + 1) * {period}) // w.weight), w.i LIMIT 1) AS p FROM e WHERE e.slot < {period} - 1)),
d AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) // {block} AS block FROM {documents})
SELECT {", ".join("d." + c.strip() for c in columns.split(","))}, w.weight, CAST(d.block AS BIGINT) AS block, CAST(d.block * {period} // w.weight AS BIGINT) AS block_release,
    CAST((d.block + 1) * {period} // w.weight + CAST((d.block + 1) * {period} % w.weight > 0 AS BIGINT) AS BIGINT) AS block_deadline,
    CAST(d.block // w.weight * {period} + e.slot AS BIGINT) AS slot
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN e ON e.pick = w.i AND e.k = d.block % w.weight
"""
