"""Layers that fail, counters observed on the pass, structured data of log lines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sigloom.operators import health, reports
from sigloom.sources import parsers


def _hit(score):
    return F.array(F.struct(F.lit("t").alias("signal_type"), score.cast("double").alias("score"), F.lit("").alias("tactic"), F.lit("T1").alias("technique")))


@pytest.fixture
def events(spark):
    return spark.range(1000).select(F.concat(F.lit("e"), F.col("id")).alias("event_id"), F.lit("h").alias("host"), F.col("id"))


def test_a_layer_that_fails_on_one_row_is_reported(spark, events, tmp_path):
    explode_on_one = F.when(F.col("id") == 777, F.raise_error(F.lit("boom on a row"))).otherwise(F.lit(0.5))
    layers = [
        ("fine", lambda: _hit(F.lit(0.5))),
        ("some", lambda: F.filter(_hit(F.lit(0.9)), lambda _: F.col("id") % 10 == 0)),
        ("runtime", lambda: _hit(explode_on_one)),
        ("plan", lambda: _hit(F.col("no_such_column"))),
    ]
    run = health.run_layers(events, layers, f"{tmp_path}/signals")
    found = {r["layer"]: (r["status"], r["signals"]) for r in run.health.collect()}
    assert found == {"fine": ("ok", 1000), "some": ("ok", 100), "runtime": ("failed", None), "plan": ("failed", None)}
    errors = {r["layer"]: r["error"] for r in run.health.collect()}
    assert "boom on a row" in errors["runtime"]
    assert "no_such_column" in errors["plan"]
    assert run.events == 1000
    assert run.signals.groupBy("layer").count().orderBy("layer").collect() == [("fine", 1000), ("some", 100)]


def test_a_failure_that_is_no_layers_is_raised(spark, tmp_path):
    broken = spark.range(5).select(F.lit("e").alias("event_id"), F.lit("h").alias("host"), F.raise_error(F.lit("bad source")).cast("string").alias("x"))
    (tmp_path / "blocked").write_text("")
    with pytest.raises(Exception, match=r"(?i)exist|directory|mkdirs|fail"):
        health.run_layers(broken.drop("x"), [("fine", lambda: _hit(F.lit(0.5)))], f"{tmp_path}/blocked/signals")


def test_no_layer_and_no_event(spark, events, tmp_path):
    run = health.run_layers(events, [], f"{tmp_path}/a")
    assert (run.events, run.signals.count()) == (1000, 0)
    run = health.run_layers(events.limit(0), [("fine", lambda: _hit(F.lit(0.5)))], f"{tmp_path}/b")
    assert (run.events, run.signals.count(), run.health.first()["signals"]) == (0, 0, 0)


def test_counters_read_no_events(spark, events, tmp_path):
    run = health.run_layers(events, [("fine", lambda: _hit(F.lit(0.5)))], f"{tmp_path}/signals")
    out = reports.run_counters(run, spark.createDataFrame([("high",), ("high",)], "severity string"))
    assert {(r["stage"], r["kind"]): r["n"] for r in out.collect()} == {("lines", "all"): 1000, ("events", "all"): 1000, ("signals", "t"): 1000, ("alerts", "high"): 2}
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    ("data", "want"),
    [
        ("-", None),
        ("[a@1]", [("a@1", [])]),
        ('[a@1 x="1"][b@2 y="2" z=""]', [("a@1", [("x", "1")]), ("b@2", [("y", "2"), ("z", "")])]),
        (r'[a x="q\"q" y="b\]b" z="s\\s" w="plain \n"]', [("a", [("x", 'q"q'), ("y", "b]b"), ("z", "s\\s"), ("w", "plain \\n")])]),
        ('[a x="1" x="2"]', [("a", [("x", "1"), ("x", "2")])]),
        ('[a x="] [b y=z"]', [("a", [("x", "] [b y=z")])]),
    ],
)
def test_structured_data(spark, data, want):
    line = f"<165>1 2024-01-15T12:00:00Z host app 12 id {data} the [message] = \"x\""
    row = spark.createDataFrame([(line,)], "v string").select(parsers.rfc5424(F.col("v")).alias("p")).select("p.message", parsers.structured_data(F.col("p.structured")).alias("s")).first()
    assert row["message"] == 'the [message] = "x"'
    assert (None if row["s"] is None else [(e["id"], [(p["name"], p["value"]) for p in e["params"]]) for e in row["s"]]) == want
