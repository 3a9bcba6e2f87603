"""Correlation in time, signals to alerts, joins on time, and dry-run responses."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions.scalars import severity
from sigloom.operators import sequences
from sigloom.operators.health import SIGNALS, Layers, layer_hits

SECOND = 1_000_000


def recon_sequence(hits: DataFrame, seconds: int = 300, edges: list[int] | None = None) -> DataFrame:
    """Enumeration at most `seconds` after the process's last identity query; hits: host, process_key, us, event_id, kind.

    edges, here and below: times that cut a key's rows (see sequences); taken from the rows where they are not given."""
    edges = sequences.splits(hits) if edges is None else edges
    identity = F.when(F.col("kind") == "recon_identity", F.col("us"))
    rows = sequences.running(sequences.bucketed(hits, edges), ["host", "process_key"], {"identity_us": identity}, edges)
    rows = rows.filter((F.col("kind") == "recon_enum") & (F.col("us") - F.col("identity_us") < seconds * SECOND))
    return rows.select("host", "process_key", "event_id", "us", "identity_us", F.lit(0.80).alias("score"), F.lit("T1087").alias("technique"))


def bruteforce(failures: DataFrame, least: int = 5, seconds: int = 120, edges: list[int] | None = None) -> DataFrame:
    """First event of each episode in which (host, src_ip) reaches `least` failures within `seconds`."""
    edges = sequences.splits(failures) if edges is None else edges
    by = Window.partitionBy("host", "src_ip", "bucket").orderBy("us", "event_id")
    rows = sequences.lagged(sequences.bucketed(failures, edges), ["host", "src_ip"], least - 1, edges)
    near = lambda later, earlier: F.coalesce(later - earlier <= seconds * SECOND, F.lit(False))
    rows = rows.withColumn("reached", near(F.col("us"), F.col("back")))
    # of a bucket's first row the one before is the last of the tail
    size = F.size("tail")
    outside = near(F.get("tail", size - 1), F.when(size >= least, F.get("tail", size - least)))
    rows = rows.withColumn("before", F.when(F.col("place") > 1, F.lag("reached", 1, False).over(by)).otherwise(outside)).filter("reached AND NOT before")
    return rows.select("host", "src_ip", "event_id", "us", F.lit("T1110.001").alias("technique"))


def union_layers(events: DataFrame, layers: Layers) -> tuple[DataFrame, dict[str, str]]:
    """All layers' signals in one pass over the events; a layer that cannot be planned is left out and reported.

    A layer makes an array of structs (signal_type, score, tactic, technique).  health.run_layers() also counts, and
    survives a layer that fails while running.
    """
    hits, failed = layer_hits(events, layers)
    everything = F.concat(*hits.values()) if hits else F.array()
    return events.select("event_id", "host", F.explode(everything.cast(SIGNALS)).alias("s")).select("event_id", "host", "s.*"), failed


def dedup(signals: DataFrame, step: float = 0.05) -> DataFrame:
    """One row per (host, event_id): largest score plus step for each further signal type, at most 1."""
    n = F.count_distinct("signal_type")
    types = F.sort_array(F.collect_set("signal_type"))
    out = signals.groupBy("host", "event_id").agg(F.max("score").alias("top"), n.alias("n_types"), types.alias("signal_types"))
    return out.select("host", "event_id", "n_types", "signal_types", F.round(F.least(F.lit(1.0), F.col("top") + step * (F.col("n_types") - 1)), 6).alias("score"))


def alerts(signals: DataFrame, floor: float = 0.3) -> DataFrame:
    """Behaviour signals of at least `floor` as alerts with severity, summary and reasoning."""
    rows = signals.filter((F.col("signal_type") == "ransomware_behavior") & (F.col("score") >= floor)).withColumn("severity", severity(F.col("score")))
    reasons = F.transform("risk_factors", lambda r: F.concat(F.lit("Risk factor matched: "), r))
    return rows.select(
        F.concat(F.lit("ALERT_"), F.col("signal_id")).alias("alert_id"),
        F.concat(F.lit("Possible ransomware activity ("), F.col("severity"), F.lit(")")).alias("title"),
        "severity",
        "confidence",
        "host",
        "process_key",
        F.concat(F.lit("Ransomware heuristic score="), F.format_string("%.2f", "score")).alias("summary"),
        reasons.alias("reasoning"),
        F.array("signal_id").alias("related_signals"),
    )


def timeline(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Events of each alert in time order; evidence: rows of alert_id and event_id."""
    ids = evidence.select("alert_id", "event_id").distinct()
    place = F.row_number().over(Window.partitionBy("alert_id").orderBy("us", "event_id"))
    rows = events.join(ids, "event_id").withColumn("place", place)
    return rows.select("alert_id", "place", "event_id", "us", "event_type", "process_name", "pid", "operation", "file_path", "dest_ip", "dest_port")


def unseen(signals: DataFrame, seen: DataFrame) -> DataFrame:
    """Signals whose id was not reported before, each once."""
    return signals.dropDuplicates(["signal_id"]).join(seen.select("signal_id"), "signal_id", "left_anti")


def corroborated(created: DataFrame, signals: DataFrame, seconds: int = 300, raise_by: float = 0.15) -> DataFrame:
    """Signals with raised confidence where the host has a creation event within `seconds`.

    An interval join kept as an equi-join: each creation is posted in its time bucket and the two next to it.
    """
    width = seconds * SECOND
    posts = created.select("host", F.col("us").alias("created_us"), F.explode(F.sequence(F.floor(F.col("us") / width) - 1, F.floor(F.col("us") / width) + 1)).alias("bucket"))
    rows = signals.withColumn("bucket", F.floor(F.col("us") / width)).join(posts, ["host", "bucket"]).filter(F.abs(F.col("us") - F.col("created_us")) <= width)
    found = rows.select("host", "event_id").distinct()
    out = signals.join(found.withColumn("hit", F.lit(True)), ["host", "event_id"], "left")
    return out.withColumn("confidence", F.round(F.when(F.col("hit"), F.least(F.lit(1.0), F.col("confidence") + raise_by)).otherwise(F.col("confidence")), 6)).withColumn("corroborated", F.coalesce("hit", F.lit(False))).drop("hit")


def lifetimes(rows: DataFrame, edges: list[int] | None = None) -> DataFrame:
    """Start (event_code 4688) to the next end (4689) of the same (host, pid), unless it starts again before."""
    edges = sequences.splits(rows) if edges is None else edges
    when = lambda code: F.when(F.col("event_code") == code, F.col("us"))
    out = sequences.running(sequences.bucketed(rows, edges), ["host", "pid"], {"end_us": when("4689"), "next_start": when("4688")}, edges, ahead=True).filter("event_code = '4688'")
    end = F.when(F.col("next_start").isNull() | (F.col("end_us") <= F.col("next_start")), F.col("end_us"))
    return out.select("host", "pid", "event_id", F.col("us").alias("start_us"), end.alias("end_us"), ((end - F.col("us")) / SECOND).alias("seconds"))


def kill_chain(signals: DataFrame, stages: tuple[str, ...] = ("T1059", "T1053.005", "T1047"), seconds: int = 600, edges: list[int] | None = None) -> DataFrame:
    """Hosts where the stages' techniques (by prefix) follow each other within `seconds` of the first.

    A stage's latest start never falls with time, so each stage is a running maximum over the hits of the one before."""
    of_stage = [F.coalesce(F.col("technique").startswith(s), F.lit(False)) for s in stages]
    rows = signals.filter(reduce(Column.__or__, of_stage))
    edges = sequences.splits(rows) if edges is None else edges
    rows = sequences.bucketed(rows, edges).withColumn("start_us", F.when(of_stage[0], F.col("us")))
    for stage in of_stage[1:]:
        rows = sequences.running(rows, ["host"], {"latest": F.col("start_us")}, edges)
        rows = rows.withColumn("start_us", F.when(stage & (F.col("us") - F.col("latest") <= seconds * SECOND), F.col("latest"))).drop("latest")
    return rows.filter("start_us IS NOT NULL").select("host", "event_id", "us", "start_us")


HABIT = ("host", "username", "parent", "child")


def habits(history: DataFrame) -> DataFrame:
    """(HABIT, block, days): on which days each spawn was seen, 64 days a block, a bit each.

    A day's habits are made from that day's rows alone and merged() into those of the days before."""
    day = F.floor(F.col("us") / (86400 * SECOND))
    bit = F.expr("shiftleft(1L, CAST(pmod(day, 64) AS INT))")
    rows = history.select(*HABIT, day.alias("day")).select(*HABIT, F.floor(F.col("day") / 64).alias("block"), bit.alias("bit"))
    return rows.groupBy(*HABIT, "block").agg(F.bit_or("bit").alias("days"))


def merged(*parts: DataFrame) -> DataFrame:
    """Habits of several spans of time together; days that are in more than one count once."""
    return reduce(DataFrame.unionByName, parts).groupBy(*HABIT, "block").agg(F.bit_or("days").alias("days"))


def not_habitual(spawns: DataFrame, known: DataFrame, days: int = 3) -> DataFrame:
    """Spawns whose (host, username, parent, child) was not seen on `days` different days; known: habits()."""
    often = known.groupBy(*HABIT).agg(F.sum(F.bit_count("days")).alias("d")).filter(F.col("d") >= days)
    return spawns.join(often, list(HABIT), "left_anti")


def iocs(texts: DataFrame) -> DataFrame:
    """(kind, ioc, n): addresses, URLs and hashes of the texts, each once."""
    # Patterns of indicators
    patterns = {"ip": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "url": r"https?://[^ \"']+", "sha256": r"\b[0-9a-f]{64}\b"}
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("ioc"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p), 0), named(k)) for k, p in patterns.items()]))
    return texts.select(F.explode(found).alias("i")).select("i.*").groupBy("kind", "ioc").agg(F.count("*").alias("n"))


class IocStore:
    """Indicators that were looked up before, with what the feed said, in a folder; none is looked up twice.

    Stored rows are in partitions by a hash of the indicator, so a run reads only the partitions of its own
    indicators (Spark prunes them by the keys of the smaller side, and filters rows by a Bloom filter of these)."""

    BUCKETS = 64
    SCHEMA = "ioc string, reputation string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """(ioc, reputation, bucket), each indicator once even where a run was repeated."""
        try:
            stored = self.spark.read.schema(f"{self.SCHEMA}, bucket int").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = self.spark.createDataFrame([], f"{self.SCHEMA}, bucket int")
        return stored.groupBy("bucket", "ioc").agg(F.max("reputation").alias("reputation"))

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.crc32(F.col("ioc").cast("binary")), F.lit(self.BUCKETS)).cast("int"))

    def look_up(self, found: DataFrame, feed: DataFrame) -> int:
        """Look up what the store does not have yet, and store it, also where the feed knows nothing; how many these were."""
        new = self.bucketed(found.select("ioc").distinct()).join(self.rows().select("bucket", "ioc"), ["bucket", "ioc"], "left_anti")
        seen = Observation()
        known = feed.groupBy("ioc").agg(F.max("reputation").alias("reputation"))
        rows = new.join(known, "ioc", "left").observe(seen, F.count("*").alias("n"))
        rows.select("ioc", "reputation", "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)
        return seen.get["n"]

    def enriched(self, found: DataFrame) -> DataFrame:
        """Indicators with their stored reputation."""
        return self.bucketed(found).join(self.rows(), ["bucket", "ioc"], "left").drop("bucket")


def enrich(found: DataFrame, feed: DataFrame) -> DataFrame:
    """(ioc, kind, n, reputation) of iocs() by a local feed of any size; IocStore keeps what was looked up."""
    return found.join(feed, "ioc", "left").select("ioc", "kind", "n", "reputation")


def response_plan(alert_rows: DataFrame) -> DataFrame:
    """Proposed actions for rows with score, signal_type and technique; nothing is executed."""
    propose = lambda test, action, risk: F.when(test, F.struct(F.lit(action).alias("action"), F.lit(risk).alias("risk")))
    behaviour = F.col("signal_type") == "ransomware_behavior"
    actions = F.array(
        propose(behaviour & (F.col("score") >= 0.95), "kill_process", "high"),
        propose(behaviour & (F.col("score") >= 0.85), "isolate_host", "high"),
        propose(F.col("technique").startswith("T1110"), "block_ip", "low"),
        propose(F.col("technique").startswith("T1078"), "revoke_session", "medium"),
        propose(F.col("technique").startswith("T1548"), "remove_setuid", "medium"),
    )
    return alert_rows.select("signal_id", F.explode(F.array_compact(actions)).alias("a")).select("signal_id", "a.*", F.lit("dry_run").alias("mode"))
