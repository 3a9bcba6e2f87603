"""Reports and hunts over signals and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.health import Run


def top_signals(signals: DataFrame, k: int = 10) -> DataFrame:
    return signals.orderBy(F.desc("score"), "signal_id").limit(k)


def by_tactic(signals: DataFrame) -> DataFrame:
    """Signals ranked by score within each tactic, with the tactic's count.

    Rows are numbered within (tactic, score, head of the id) and the counts of these give each
    one's first place, so a tactic with most of the signals is the work of many tasks.
    """
    key = ["tactic", "__score", "__head"]
    # ids are `sig-` and a hash: their first 7 characters spread a score over 4096 windows
    rows = signals.select(F.coalesce(F.nullif("tactic", F.lit("")), F.lit("Unknown")).alias("tactic"), "signal_id", "score", F.coalesce("score", F.lit(float("-inf"))).alias("__score"), F.coalesce(F.substring("signal_id", 1, 7), F.lit("")).alias("__head"))
    before = Window.partitionBy("tactic").orderBy(F.desc("__score"), "__head").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    counts = counts.select(*key, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"), F.sum("__n").over(Window.partitionBy("tactic")).alias("n_tactic"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("signal_id"))
    return rows.withColumn("place", place).join(counts, key).select("tactic", "n_tactic", (F.col("__first") + F.col("place")).cast("int").alias("place"), "signal_id", "score")


def coverage(signals: DataFrame) -> DataFrame:
    """Largest score of each tactic and technique, with subtotals."""
    return signals.rollup("tactic", "technique").agg(F.max("score").alias("score"), F.count("*").alias("n"))


def gaps(catalogue: DataFrame, signals: DataFrame) -> DataFrame:
    return catalogue.join(signals.select("technique").distinct(), "technique", "left_anti")


def hunt(events: DataFrame, wildcards: tuple[str, ...], by: tuple[str, ...], values: tuple[str, ...] = (), column: str = "command_line") -> DataFrame:
    """Events whose column is like any wildcard (lower case): count and distinct values by the given columns."""
    test = F.lit(False)
    for w in wildcards:
        test = test | F.lower(column).like(w)
    agg = [F.count("*").alias("n"), *[F.array_join(F.sort_array(F.collect_set(v)), ",").alias(f"{v}s") for v in values]]
    return events.filter(test).groupBy(*by).agg(*agg)


def run_counters(run: Run, alert_rows: DataFrame) -> DataFrame:
    """(stage, kind, n): lines, events, signals by type, alerts by severity.

    Lines and events were counted on the pass that wrote the signals; no events are read for them."""
    spark = alert_rows.sparkSession
    each = lambda df, name, c: df.groupBy(F.col(c).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "kind", "n")
    total = spark.createDataFrame([("lines", "all", run.events), ("events", "all", run.events)], "stage string, kind string, n long")
    return total.unionByName(each(run.signals, "signals", "signal_type")).unionByName(each(alert_rows, "alerts", "severity"))
