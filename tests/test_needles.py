"""The automaton against plain search, and binary files as a source."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import needles, packs, rules
from sigloom.sources import binaries


def _joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])


@pytest.mark.parametrize("piece", [4096, 5])
def test_automaton_equals_plain_search(monkeypatch, piece):
    monkeypatch.setattr(needles, "PIECE", piece)
    rng = random.Random(5)
    word = lambda n: bytes(rng.choice(b"abc\x00\xff") for _ in range(n))
    for _ in range(30):
        wanted = sorted({word(rng.randrange(0, 5)) for _ in range(rng.randrange(0, 12))})
        texts = [word(rng.choice([0, 1, 3, 30, 80])) for _ in range(40)]
        text, needle = needles.Automaton(wanted).find(*_joined(texts))
        got = list(zip(text.tolist(), needle.tolist(), strict=True))
        assert got == [(i, k) for i, t in enumerate(texts) for k, n in enumerate(wanted) if n in t]


def test_cost_does_not_follow_the_number_of_needles():
    rng = random.Random(9)
    name = lambda: bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz-./ ") for _ in range(rng.randrange(8, 20)))
    data = _joined([bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz-./ ") for _ in range(120)) for _ in range(10_000)])
    took = []
    for many in (40, 2000):
        automaton = needles.Automaton(sorted({name() for _ in range(many)}))
        automaton.find(*data)
        best = []
        for _ in range(3):
            began = time.perf_counter()
            automaton.find(*data)
            best.append(time.perf_counter() - began)
        took.append(min(best))
    assert took[1] < 4 * took[0]


@pytest.mark.parametrize("lower", [False, True])
def test_sigma_many_equals_expressions(spark, lower):
    rng = random.Random(3)
    flat = [n for own in packs.PACKS.values() for v in own.values() for n in v if not n.startswith("re:")]
    texts = [" ".join(rng.choice([rng.choice(flat), "dir", "é ü", "curl x | bash"]) for _ in range(rng.randrange(5))) for _ in range(400)] + [None, ""]
    events = spark.createDataFrame([(f"e{i}", "h", t) for i, t in enumerate(texts)], "event_id string, host string, command_line string").repartition(3)
    rows = lambda df: sorted((r["event_id"], r["pack"], tuple(r["selections"]), r["score"]) for r in df.collect())
    got = rows(needles.sigma_many(events, packs.PACKS, lower))
    assert got == rows(rules.sigma_all(events, tuple(packs.PACKS), lower))
    assert len(got) > 300


def test_binary_files(spark, tmp_path):
    rng = random.Random(1)
    content = {f"m{i}.GGUF": bytes(rng.randrange(256) for _ in range(1000 + i)) for i in range(4)} | {"deep/x.bin": b"", "note.txt": b"text", "big.safetensors": b"z" * 5000}
    elf = b"\x7fELF" + b"connect socket dup2 execvp fork " + b"\x23\x00\x00\x00" + bytes(range(256))
    content |= {"sample": elf, "family": b"\x7fELF\x02\x00\n\xbb\xcc\xdd\xee\xff socket dup2 execvp", "neither": b"\x00" + elf}
    for name, data in content.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    short = lambda p: p.split("/in/")[1]
    found = {short(r["path"]): r["hash"] for r in binaries.file_hashes(spark, f"{tmp_path}/in", most=4000).collect()}
    models = [n for n in content if n.lower().endswith(packs.MODEL_SUFFIXES) and content[n]]
    assert found == {n: None if n.startswith("big") else hashlib.sha256(content[n]).hexdigest() for n in models}
    hits = {(short(r["path"]), r["rule"]) for r in binaries.scanned(spark, f"{tmp_path}/in", most=4000).collect()}
    assert hits == {("sample", "exact_sample"), ("family", "family"), ("big.safetensors", "too_long")}
    lazy = binaries.file_hashes(spark, f"{tmp_path}/in").withColumn("host", F.lit("h"))
    base = spark.createDataFrame(lazy.collect(), lazy.schema)
    (tmp_path / "in" / "m2.GGUF").write_bytes(b"changed")
    assert [short(r["path"]) for r in binaries.changed_models(spark, f"{tmp_path}/in", "h", base).collect()] == ["m2.GGUF"]
    plan = binaries.binaries(spark, f"{tmp_path}/in").filter("length <= 10").select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10)" in plan
    assert "content" not in plan
