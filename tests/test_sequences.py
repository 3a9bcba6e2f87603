"""Two-level scans of hot keys against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sigloom.operators import correlate, sequences

S = 1_000_000


def _rows(seed, kinds, key_of, n=1500, span=4000):
    """Nine of ten rows belong to one key; many share a time; some keys are null."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = key_of(0) if rng.random() < 0.9 else key_of(rng.choice([1, 2, None]))
        out.append((*key, rng.randrange(span) * S // rng.choice([1, 1, 3]), f"e{rng.randrange(10**6):06d}{i}", rng.choice(kinds)))
    return out


def _by_key(rows):
    groups = defaultdict(list)
    for a, b, us, event_id, kind in rows:
        groups[a, b].append((us, event_id, kind))
    return {k: sorted(v) for k, v in groups.items()}


def _edges(df, mode):
    return {"one": [], "many": sequences.splits(df, size=40), "each": sorted({r["us"] for r in df.select("us").distinct().collect()})}[mode]


@pytest.fixture(params=["one", "many", "each"])
def mode(request):
    return request.param


def test_recon_equals_loop(spark, mode):
    rows = _rows(1, ["recon_identity", "recon_enum", "recon_enum", "recon_enum"], lambda k: (None if k is None else f"h{k}", "p"))
    df = spark.createDataFrame(rows, "host string, process_key string, us long, event_id string, kind string")
    want = set()
    for group in _by_key(rows).values():
        last = None
        for us, event_id, kind in group:
            last = us if kind == "recon_identity" else last
            if kind == "recon_enum" and last is not None and us - last < 5 * S:
                want.add((event_id, last))
    got = correlate.recon_sequence(df, 5, _edges(df, mode)).collect()
    assert len(got) == len(want)
    assert {(r["event_id"], r["identity_us"]) for r in got} == want


@pytest.mark.parametrize("least", [2, 5])
def test_bruteforce_equals_loop(spark, mode, least):
    rows = _rows(2, ["f"], lambda k: ("h", None if k is None else f"ip{k}"))
    df = spark.createDataFrame(rows, "host string, src_ip string, us long, event_id string, kind string")
    want = set()
    for group in _by_key(rows).values():
        before = False
        for i, (us, event_id, _) in enumerate(group):
            reached = i >= least - 1 and us - group[i - least + 1][0] <= 3 * S
            if reached and not before:
                want.add(event_id)
            before = reached
    got = [r["event_id"] for r in correlate.bruteforce(df, least, 3, _edges(df, mode)).collect()]
    assert want
    assert sorted(got) == sorted(want)


def test_lifetimes_equal_loop(spark, mode):
    rows = _rows(3, ["4688", "4689"], lambda k: ("h", k), n=600)
    df = spark.createDataFrame(rows, "host string, pid long, us long, event_id string, event_code string")
    want = {}
    for group in _by_key(rows).values():
        for i, (_, event_id, code) in enumerate(group):
            if code == "4688":
                end = next((r[0] for r in group[i + 1 :] if r[2] == "4689"), None)
                start = next((r[0] for r in group[i + 1 :] if r[2] == "4688"), None)
                want[event_id] = end if end is not None and (start is None or end <= start) else None
    got = {r["event_id"]: r["end_us"] for r in correlate.lifetimes(df, _edges(df, mode)).collect()}
    assert got == want


def test_looking_ahead_takes_each_row_once(spark, mode):
    """No frame reaches to the end of a key: such a frame is added up anew for each of its rows, which is quadratic."""
    rows = _rows(5, ["4688", "4689"], lambda k: ("h", k), n=60)
    df = spark.createDataFrame(rows, "host string, pid long, us long, event_id string, event_code string")
    plan = correlate.lifetimes(df, _edges(df, mode))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan
    assert "unboundedfollowing" not in plan


def test_kill_chain_equals_loop(spark, mode):
    rows = _rows(4, ["T1059.001", "T1053.005", "T1047", "T9999", None], lambda k: (None if k is None else f"h{k}", "x"))
    df = spark.createDataFrame(rows, "host string, x string, us long, event_id string, technique string")
    want = set()
    for group in _by_key(rows).values():
        first = second = None
        for us, event_id, technique in sorted(group, key=lambda r: r[:2]):
            if (technique or "").startswith("T1059"):
                first = us
            if (technique or "").startswith("T1053.005") and first is not None and us - first <= 20 * S:
                second = first
            if (technique or "").startswith("T1047") and second is not None and us - second <= 20 * S:
                want.add((event_id, second))
    got = [(r["event_id"], r["start_us"]) for r in correlate.kill_chain(df, seconds=20, edges=_edges(df, mode)).collect()]
    assert want
    assert sorted(got) == sorted(want)


def test_a_hot_key_is_cut_evenly(spark):
    """A key with all rows, most of them in a burst: no bucket holds many more than its share."""
    burst = spark.range(20_000).select((F.col("id") % 997 + 5_000_000).alias("us")).union(spark.range(500).select((F.col("id") * S * 60).alias("us")))
    edges = sequences.splits(burst, size=1000)
    sizes = [r["count"] for r in sequences.bucketed(burst, edges).groupBy("bucket").count().collect()]
    assert len(sizes) >= 15
    assert max(sizes) <= 2000


def test_what_meets_for_a_key_is_a_state_a_bucket(spark):
    """The window over a key alone comes behind the aggregation of its buckets."""
    df = spark.range(5000).select(F.lit("h").alias("host"), F.lit("p").alias("process_key"), (F.col("id") * S).alias("us"), F.col("id").cast("string").alias("event_id"), F.lit("recon_enum").alias("kind"))
    edges = sequences.splits(df, size=100)
    states = sequences._states(sequences.bucketed(df, edges), ["host", "process_key"], {"x": F.col("us")}, ahead=False)
    assert states.count() == len(edges) + 1


def test_splits_of_nothing(spark):
    df = spark.createDataFrame([], "host string, process_key string, us long, event_id string, kind string")
    assert sequences.splits(df) == []
    assert correlate.recon_sequence(df).count() == 0
