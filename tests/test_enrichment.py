"""Indicator store, habits as bits, VARIANT fields, bounded documents."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sigloom.operators import correlate
from sigloom.sources import parsers, sinks

DAY = 86_400_000_000


def test_no_indicator_is_looked_up_twice(spark, tmp_path):
    store = correlate.IocStore(spark, f"{tmp_path}/store")
    text = spark.createDataFrame([("call http://a/b and 10.0.0.1",), ("10.0.0.1 again " + "ab" * 32,), (None,)], "text string")
    found = correlate.iocs(text)
    feed = spark.createDataFrame([("10.0.0.1", "internal"), ("10.0.0.1", "internal"), ("http://a/b", "bad"), ("x", "y")], "ioc string, reputation string")
    assert store.look_up(found, feed) == 3
    assert store.look_up(found, feed) == 0
    got = {r["ioc"]: (r["kind"], r["n"], r["reputation"]) for r in store.enriched(found).collect()}
    assert got == {"10.0.0.1": ("ip", 2, "internal"), "http://a/b": ("url", 1, "bad"), "ab" * 32: ("sha256", 1, None)}
    more = correlate.iocs(spark.createDataFrame([("10.0.0.1 10.0.0.2",)], "text string"))
    assert store.look_up(more, spark.createDataFrame([("10.0.0.1", "changed"), ("10.0.0.2", "new")], feed.schema)) == 1
    assert {(r["ioc"], r["reputation"]) for r in store.enriched(more).collect()} == {("10.0.0.1", "internal"), ("10.0.0.2", "new")}
    # a run that was repeated after it had stored its rows
    spark.createDataFrame([("10.0.0.2", "new")], store.SCHEMA).transform(store.bucketed).write.mode("append").partitionBy("bucket").parquet(store.path)
    assert store.enriched(more).count() == 2


def test_a_feed_beyond_the_broadcast_limit(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        feed = spark.range(20_000).select(F.concat(F.lit("10.0."), F.floor(F.col("id") / 250), F.lit("."), F.col("id") % 250).alias("ioc"), F.lit("bad").alias("reputation"))
        found = correlate.iocs(spark.createDataFrame([("10.0.3.4 8.8.8.8",)], "text string"))
        rows = correlate.enrich(found, feed)
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
        assert {(r["ioc"], r["reputation"]) for r in rows.collect()} == {("10.0.3.4", "bad"), ("8.8.8.8", None)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("days", [1, 3, 70])
def test_habits_equal_count_distinct(spark, days):
    rng = random.Random(7)
    rows = [(f"h{rng.randrange(2)}", rng.choice(["u", None]), "p", f"c{rng.randrange(4)}", rng.randrange(-130 if rng.random() < 0.5 else 0, 130) * DAY + rng.randrange(DAY), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "host string, username string, parent string, child string, us long, event_id long")
    seen: dict = {}
    for *key, us, _ in rows:
        seen.setdefault(tuple(key), set()).add(us // DAY)
    want = sorted(r[5] for r in rows if r[1] is None or len(seen[tuple(r[:4])]) < days)
    # day by day, some days twice
    early, late = df.filter(f"us < {20 * DAY}"), df.filter(f"us >= {10 * DAY}")
    known = correlate.merged(correlate.habits(early), correlate.habits(late))
    assert sorted(r["event_id"] for r in correlate.not_habitual(df, known, days).collect()) == want
    assert sorted(r["event_id"] for r in correlate.not_habitual(df, correlate.habits(df), days).collect()) == want


def test_variant_fields_equal_paths(spark):
    rng = random.Random(2)
    value = lambda: rng.choice([None, "", "text", 'say "x"', 4688, "4688", "é\n", True])
    lines = []
    for _ in range(300):
        event = {"Hostname": value(), "EventID": value(), "EventData": rng.choice([None, {"NewProcessName": value(), "CommandLine": value(), "SubjectUserName": value()}, "flat"])}
        other = {"host": rng.choice([{"hostname": value()}, "name"]), "event": {"code": value()}, "winlog": {"event_data": {"NewProcessName": value(), "ProcessId": value()}, "user": {"name": value()}}}
        lines.append(json.dumps({k: v for k, v in {**event, **other}.items() if rng.random() < 0.7}))
    df = spark.createDataFrame([(x,) for x in [*lines, "", "{broken", "[1]", "null", None]], "value string")
    plain = F.struct(*[F.coalesce(*[F.get_json_object("value", p[f]) for p in (parsers.NXLOG, parsers.WINLOGBEAT)]).alias(f) for f in parsers.NXLOG])
    rows = df.select("value", parsers.windows_json(F.col("value")).alias("made"), plain.alias("want")).collect()
    assert [(r["value"], r["made"], r["want"]) for r in rows if r["want"] != r["made"] and any(r["want"])] == []
    layouts = parsers.raw_schema(df).collect()
    assert sum(r["n"] for r in layouts) == 305
    assert any(r["layout"] is None for r in layouts)


def test_a_document_gathers_no_more_than_it_may(spark):
    df = spark.range(50).select(F.col("id").alias("pid"))
    assert len(json.loads(sinks.document(df, most=50).first()[0])["suspicious_processes"]) == 50
    with pytest.raises(Exception, match="too many"):
        sinks.document(df, most=49).collect()
    assert "Limit" in sinks.document(df, most=10)._jdf.queryExecution().optimizedPlan().toString()
