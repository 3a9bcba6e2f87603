"""Near-duplicate, suffix and embedding operators against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import embedding_dedup, minhash_dedup, suffix_dedup


def _components(n, link):
    label = list(range(n))
    while True:
        new = [min([label[i]] + [label[j] for j in range(n) if link[i][j]]) for i in range(n)]
        if new == label:
            return label
        label = new


def _family_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(60)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(60)] = word()
            texts.append(" ".join(copy))
    return [*texts, texts[0], "", None, "one", "ONE", "two words", "Two  words\n"]


@pytest.mark.parametrize(("light", "block"), [(64, 128), (2, 4)])
def test_minhash_equals_brute_force(spark, monkeypatch, light, block):
    monkeypatch.setattr(minhash_dedup, "LIGHT", light)
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    texts = _family_texts()
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    link = [[i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("key", F.lit("x"))
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs, 2).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == _components(len(texts), link)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


@pytest.mark.parametrize(("light", "block"), [(64, 128), (2, 4)])
def test_minhash_ids_with_several_texts(spark, monkeypatch, light, block):
    """Families of near copies over long lists; each id has a second, unrelated text."""
    monkeypatch.setattr(minhash_dedup, "LIGHT", light)
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common, rows, families = [word() for _ in range(40)], [], 4
    each = 90 if light == 64 else 20
    for f in range(families):
        base = common + [word() for _ in range(60)]
        for i in range(each):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(100)] = word()
            rows.append((f * each + i, " ".join(copy)))
    rows += [(i, " ".join(word() for _ in range(30))) for i in range(families * each)]
    sets = [{tuple(w[k : k + 2]) for k in range(len(w) - 1)} for w in (t.split() for _, t in rows)]
    n = families * each
    label = list(range(n))
    link = [[10 * len(a & b) >= 8 * len(a | b) for b in sets[:n]] for a in sets[:n]]
    while (new := [min(label[j] for j in range(n) if link[i][j]) for i in range(n)]) != label:
        label = new
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {(r["doc_id"], r["component_id"]) for r in minhash_dedup.near_duplicates(docs, 2).collect()}
    assert got == set(enumerate(label))


def test_minhash_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x")], "doc_id long, text string")
    rows = minhash_dedup.near_duplicates(docs).collect()
    assert len(rows) == 4
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"]) == [(1, 1, True), (1, 1, True), (2, 2, True)]
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, False)]
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_suffix_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    passage, line = text(180), "=" * 400
    texts = [text(300) + passage, passage + text(50), text(20) + passage[40:170], line, line, line[:99], "", None, text(10) + line, passage[:99], text(300)]
    texts.append(texts[0])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    got = {r["doc_id"]: r for r in suffix_dedup.digest(docs).collect()}
    want = suffix_dedup.brute_force([(i, (t or "").encode()) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len((t or "").encode()), sum(b - a for a, b in want[i]), len(want[i])), i
    assert suffix_dedup.digest(docs.limit(0)).count() == 0
    again = suffix_dedup.digest(spark.createDataFrame([(None, line), (7, line), (7, line)], "doc_id long, text string")).collect()
    # a run of one byte repeats inside the first document too: its own first 100 bytes stay
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in again) == [(0, 400), (7, 399), (7, 399)]


def test_suffix_rows_that_share_an_id(spark, monkeypatch):
    """Null and equal ids spread over blocks; kept bytes equal brute force in (doc_id, digest) order."""
    rng = random.Random(15)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [text(150) for _ in range(6)]
    texts = [text(800) + rng.choice(passages) + text(700) for _ in range(900)]
    rows = [(None if i % 3 == 0 else 4 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    rows += rows[:40] + [(5, passages[0] * 3)] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "BLOCK_LEAST", 1 << 17)  # a dozen blocks
    monkeypatch.setattr(suffix_dedup, "BLOCK_MOST", 1 << 17)
    got = {}
    for r in suffix_dedup.digest(df).collect():
        got.setdefault((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]), 0)
        got[r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]] += 1
    order = sorted({(1 << 62 if i is None else i, hashlib.sha256(t.encode()).hexdigest(), t) for i, t in rows})
    spans = suffix_dedup.brute_force([(k, t.encode()) for k, (_, _, t) in enumerate(order)])
    want = {}
    for k, (i, _, t) in enumerate(order):
        data = t.encode()
        kept = b"".join(data[a:b] for a, b in zip([0, *[e for _, e in spans[k]]], [*[s for s, _ in spans[k]], len(data)], strict=True))
        key = (None if i == 1 << 62 else i, len(data), len(data) - len(kept), len(spans[k]), hashlib.sha256(kept).hexdigest())
        want[key] = want.get(key, 0) + sum((1 << 62 if x is None else x, y) == (i, t) for x, y in rows)
    assert got == want


def test_cover_is_a_difference_cover():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


def test_embeddings_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 64))
    near = base[:, None] + rng.normal(size=(40, 5, 64)) * 0.16
    vectors = near.reshape(-1, 64).astype(np.float32)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, None, 0), (n + 2, [0.0] * 64, 0), (n + 3, [float("nan")] * 64, 0), (n + 4, rows[0][1], None), (n + 5, [None] * 64, 0), (n + 6, [1.0, 2.0], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cls", F.lit(1))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    same = (unit @ unit.T >= 0.98) & (np.arange(n)[:, None] % 2 == np.arange(n)[None] % 2) & ~np.eye(n, dtype=bool)
    want = same.sum()
    found = sum(got[i]["n_links"] - int(same[0, i] and i != 0) - int(i == 0) for i in range(n))
    assert want > 50
    assert found <= want
    assert found >= 0.95 * want
    assert [got[n + k]["n_links"] for k in (1, 2, 3, 4, 5, 8)] == [0] * 6
    assert (got[n + 7]["component_id"], got[n + 7]["n_links"]) == (n + 6, 1)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def _brute_links(vectors, labels, bar=0.98):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return (unit @ unit.T >= bar) & (labels[:, None] == labels[None]) & ~np.eye(len(vectors), dtype=bool)


@pytest.mark.parametrize(("dimensions", "light"), [(16, 128), (64, 128), (64, 4), (8, 4)])
def test_embedding_links_and_components(spark, monkeypatch, dimensions, light):
    """Clusters of different vectors, ties, repeats; with small buckets in blocks too."""
    monkeypatch.setattr(embedding_dedup, "LIGHT", light)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8 if light == 4 else 512)
    rng = np.random.default_rng(dimensions)
    base = rng.normal(size=(30, dimensions))
    near = base[:, None] + rng.normal(size=(30, 8, dimensions)) * 0.13
    one = base[0] + rng.normal(size=(60, dimensions)) * 0.1
    vectors = np.concatenate([near.reshape(-1, dimensions), one, one[:5]])
    labels = np.concatenate([np.arange(240) % 2, np.zeros(65, int)])
    link = _brute_links(vectors, labels)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vectors, labels, strict=True))]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found, want = np.array([got[i]["n_links"] for i in range(len(rows))]), link.sum(1)
    assert (found <= want).all()
    assert found.sum() >= 0.95 * want.sum()
    label = _components(len(rows), link)
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(rows))]) >= 0.95
    assert all(got[300 + i]["component_id"] == got[240 + i]["component_id"] for i in range(5))


def test_unrelated_vectors_meet_about_linearly(spark):
    """Four times the vectors do not make sixteen times the pairs that meet; few dimensions too."""
    none = spark.createDataFrame([], "label string, d int, t int, key long")
    for dimensions in (16, 64):
        made = []
        for n in (1000, 4000):
            rng = np.random.default_rng(n)
            df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(n, dimensions)))], "vec_id long, embedding array<double>, label int")
            bits, tables = embedding_dedup.layout(n)
            coded = embedding_dedup.encode(df, embedding_dedup.learn(df, bits * tables), bits)
            classes = coded.withColumn("d", F.size("v")).withColumn("id", F.col("vec_id")).cache()
            made.append(embedding_dedup.candidates(classes, none, bits, tables).count())
        assert made[0] < 10 * 1000
        assert made[1] < 10 * 4000, (dimensions, made)


def test_embeddings_of_extreme_size(spark):
    rows = [(1, [1e200, 2e200], "x"), (2, [1e-200, 2e-200], "x"), (3, [-1e200, 1.0], "x"), (4, [0.0, -0.0], "x")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}
