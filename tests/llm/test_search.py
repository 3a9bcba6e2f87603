"""Lexical and vector search, and conversation repair, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.llm import conversation_repair, lexical_search, vector_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _ranking(docs, items, k=10):
    bags = [(d, Counter(_terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = set()
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(_terms(t))
    for i, terms in asked.items():
        scored = []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * n) // words if words else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms if b[t])
            if s > 0:
                scored.append((-s, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out |= {(i, r + 1, d, -s) for r, (s, _, d) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize(("segment", "step", "dense", "block"), [(16 << 20, 64, 16, 2_000_000), (2000, 1, 1, 5), (600, 2, 0, 2_000_000)])
def test_lexical_search_equals_brute_force(spark, monkeypatch, segment, step, dense, block):
    for name, value in (("SEGMENT_BYTES", segment), ("STEP", step), ("DENSE", dense), ("QUERY_TERMS", block), ("SHARES", 3)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.7))}"
    docs = [(i, " ".join(word() for _ in range(rng.choice((1, 5, 40, 90))))) for i in range(250)]
    docs += [(7, docs[7][1]), (300, docs[7][1]), (None, docs[7][1]), (301, None), (302, ""), (303, "... !"), (304, "Große ÉCOLE w1 W1"), (305, "w2 " * 9000 + "rare")]
    items = [(i, docs[i * 5][1][:200]) for i in range(20)] + [(50, "große école"), (51, "w1 w2 w3"), (52, None), (53, "unknownterm"), (51, "rare"), (None, "w5 w9 ÉCOLE")]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    got = [tuple(r) for r in lexical_search.search(left, right).collect()]
    assert len(got) == len({(i, r) for i, r, _, _ in got})
    assert set(got) == _ranking(docs, items)
    assert lexical_search.search(left.limit(0), right).count() == 0
    assert lexical_search.search(left, right.limit(0)).count() == 0


def test_best_positions_stop_early():
    """Two lists led by the same documents: the search ends long before the lists do."""
    size = 20_000
    counts = np.full(size, 2)
    flat = np.frombuffer(b"ab" * size, np.uint8)
    row = {k: v[0] for k, v in lexical_search._segment(0, list(range(size)), [flat], [np.arange(2 * size)], counts, size, 2 * size).to_pydict().items()}
    segment = lexical_search.Segment(row, pa.array([b"a", b"b"], pa.large_binary()))
    impacts = np.linspace(900_000, 1000, size).astype(np.int32)
    segment.impacts = np.concatenate((impacts, impacts))
    best = lexical_search.Best.none(10)
    depth = lexical_search.best_positions(segment, np.array([0, 1]), np.array([5, 5]), best)
    assert depth <= 2 * lexical_search.STEP
    assert best.ids.tolist() == list(range(10))


def _nearest(rows, k=5, every=50):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    fine = [(i, np.ldexp(v, -math.frexp(max(map(abs, v)))[1]).tolist()) for i, v in fine]
    out = []
    for n, (q, v) in enumerate(fine):
        if q % every:
            continue
        norm = lambda x: math.sqrt(np.cumsum(np.array(x) ** 2)[-1])
        found = sorted((-(np.cumsum(np.array(v) * np.array(w))[-1] / (norm(v) * norm(w))), i) for m, (i, w) in enumerate(fine) if m != n and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("bytes_a_block", [32 << 20, 4000])
def test_vector_search_equals_brute_force(spark, monkeypatch, bytes_a_block):
    monkeypatch.setattr(vector_search, "QUERY_BYTES", bytes_a_block)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=32).round(3).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # a group of copies, with a query in it
    rows += [(2000 + i, rng.normal(size=3).tolist()) for i in range(120)]
    rows += [(3000, None), (3050, []), (3100, [0.0] * 32), (3150, [float("nan")] * 32), (3200, [None] + [1.0] * 31), (None, rows[1][1]), (50, rows[50][1]), (3250, [1e300] * 32), (3300, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("rank", F.lit("x")).repartition(3)
    got = [tuple(r) for r in vector_search.search(df, "vec_id % 50 = 0").collect()]
    assert Counter(got) == Counter(_nearest(rows))
    assert vector_search.search(df.limit(0), "vec_id % 50 = 0").count() == 0


@pytest.mark.parametrize("d", [8, 64, 700])
def test_vector_estimates_stay_within_their_bounds(d):
    rng = np.random.default_rng(d)
    v = rng.normal(size=(2000, d))
    norm = np.linalg.norm(v, axis=1)
    turned = vector_search.rotate(v / norm[:, None])
    assert np.allclose(np.linalg.norm(turned, axis=1), 1)
    code = np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64)
    asked = vector_search.Asked(np.arange(50), v[:50], norm[:50], 5)
    estimate, bound = asked.estimates(code, np.abs(turned).sum(1) / math.sqrt(turned.shape[1]), 0, 50)
    error = estimate - (v / norm[:, None]) @ (v[:50] / norm[:50, None]).T
    assert (np.abs(error) > bound).mean() < 0.001
    assert abs(error.mean()) < 0.01


def test_vector_search_reranks_few(spark):
    """Neighbours apart from the rest: bounds keep nearly all vectors from being reranked."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(8000, 128))
    v[40:80] = v[:40] + 0.3 * rng.normal(size=(40, 128))
    norm = np.sqrt(vector_search.ordered_dot(v, v))
    turned = vector_search.rotate(v / norm[:, None])
    code, fit = np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64), np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
    asked = vector_search.Asked(np.arange(40), v[:40], norm[:40], 1)
    for lo in range(0, 8000, 1000):
        hi = lo + 1000
        asked.scan(np.arange(lo, hi), np.arange(lo, hi), v[lo:hi], norm[lo:hi], code[lo:hi], fit[lo:hi])
    assert asked.ids.tolist() == list(range(40, 80))
    assert asked.reranked < 0.01 * 40 * 8000


def _repaired(rows):
    """An independent reading of the contract: all ways through the turns, with whole audits."""
    lead = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    made = ("user", "assistant")
    convs: dict = {}
    for c, t, r, x in rows:
        own = convs.setdefault(c, [])
        said = lambda v: " " if v is None else str(v)
        way = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        x = "" if way == 1 else re.sub("[.!?]", "", said(x)) if way == 2 else said(x)
        own += [(t, "user" if way == 4 else said(r), x)] * (0 if way == 0 else 2 if way == 3 else 1)
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        seen, faults = set(), []
        for _, r, x in own:
            core = x.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((r, x))

        def inserts(ways):
            for _ in range(3):
                for s, (cost, audit, lines) in list(ways.items()):
                    for name in made:
                        if name[0] in lead[s]:
                            new = (cost + 5, audit + "I", (*lines, f"{name}:"))
                            ways[lead[s][name[0]]] = min(ways.get(lead[s][name[0]], new), new)
            return ways

        ways = {0: (0, "", ())}
        for (_, r, x), fault in zip(own, faults, strict=True):
            then: dict = {}
            for s, (cost, audit, lines) in inserts(dict(ways)).items():
                options = [(s, (cost + 2, audit + "D", lines))]
                if fault not in ("blank", "duplicate"):
                    more = cost + 5 * (fault == "truncated")
                    options += [(lead[s][r[:1]], (more, audit + "K", (*lines, f"{r}:{x}")))] if r[:1] in lead[s] else []
                    options += [(lead[s][n[0]], (more + 1, audit + "R", (*lines, f"{n}:{x}"))) for n in made if n[0] in lead[s]]
                for to, new in options:
                    then[to] = min(then.get(to, new), new)
            ways = then
        cost, audit, lines = min(w for s, w in inserts(dict(ways)).items() if s in (0, 3))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _conversations():
    rng, rows = random.Random(1), []
    for c in [None, *range(60)]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 40])):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "sys"]), rng.choice(["Hi.", "Ok!", "cut", "", " ", None, "a. b", "same.", f"x{t}.", f"y{t}?"])))
    # one conversation with most of the rows, many of them equal
    return rows + [(777, t // 3, rng.choice(["user", "assistant"]), rng.choice(["Hi.", f"cut {t}", f"w{t}.", f"z{t}!"])) for t in range(900)] + [(777, 5, "user", "Hi.")] * 50


@pytest.mark.parametrize("block", [4096, 7, 1])
def test_conversation_repair_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rows = _conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", F.lit(1)).withColumn("part", F.lit("x")).repartition(5)
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = [(r["conv_id"], tuple(r[c] for c in columns)) for r in conversation_repair.repaired_conversations(df).collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == _repaired(rows)


def test_conversation_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repaired_conversations(df).count() == 0


def test_hot_conversation_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 50)
    rows = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(2000)], "conv_id long, turn long, role string, text string")
    packed = conversation_repair.blocks(conversation_repair.marked(conversation_repair.damaged(rows)))
    assert packed.agg(F.max(F.size("rows"))).first()[0] <= 50
    assert packed.select("part").distinct().count() > 1
