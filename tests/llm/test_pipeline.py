"""The corpus pipeline as a whole, against brute force on a small corpus."""

from __future__ import annotations

import random
import re

import duckdb

import corpus_pipeline
from sigloom.llm import mixing, suffix_dedup

WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _corpus():
    rng = random.Random(31)
    vocabulary = {"aa": ["".join(rng.choice("bcdfgaeio") for _ in range(rng.randrange(3, 8))) for _ in range(150)], "zz": ["".join(rng.choice("äöüßxyzwv") for _ in range(rng.randrange(3, 8))) for _ in range(150)]}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    items = [text("aa", 14), text("zz", 10), "Rare Pair", ""]
    passage = text("zz", 30)
    rows = []
    for i in range(40):
        lang = "aa" if i % 3 else "zz"
        body = text(lang, 40 + 3 * i)
        if i % 5 == 0:
            body += " " + passage + " " + text(lang, 10)
        if i % 7 == 0:
            body = text(lang, 12) + ". " + items[i % 2].upper() + ", " + body
        rows.append([i, body, lang if i % 4 else None, ["web", "books", None][i % 3]])
    for i, near in ((40, 3), (41, 3), (42, 11)):
        words = rows[near][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append([i, " ".join(words), None, "web"])
    rows += [[43, rows[5][1], None, "web"], [44, "1234 ...", "aa", "web"], [45, None, "aa", "web"], [46, items[1], "zz", "books"], [47, "rare-PAIR", "aa", "books"], [48, "", "aa", "web"], [9, rows[9][1], "aa", "web"]]
    return [(*r, len(r[1] or "")) for r in rows], [(k, t) for k, t in enumerate(items)]


def _near(rows):
    def shingles(t):
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0d]+", t)]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    ids = sorted({r[0] for r in rows})
    sets = {i: shingles(next(r[1] for r in rows if r[0] == i)) for i in ids}
    label = {i: i for i in ids}
    while (new := {i: min(label[j] for j in ids if i == j or (sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))) for i in ids}) != label:
        label = new
    return {i for i in ids if label[i] == i}


def _without_benchmark(text, items):
    words = [m.span() for m in WORD.finditer(text)]
    low = [text[a:b].lower() for a, b in words]
    hit = set()
    for _, t in items:
        w = [x.lower() for x in WORD.findall(t)]
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            hit |= {p for s in range(len(low) - n + 1) if low[s : s + n] == w[k : k + n] for p in range(s, s + n)}
    out, at = "", 0
    for k, (a, _) in enumerate(words):
        if k in hit:
            out += text[at:a]
            at = words[k + 1][0] if k + 1 < len(words) else len(text)
    return out + text[at:]


def test_run_equals_brute_force(spark, tmp_path):
    rows, items = _corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]

    rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    keep = _near(rows)
    rows = list({(r[0], r[1]): r for r in rows if r[0] in keep}.values())
    spans = suffix_dedup.brute_force([(r[0], r[1].encode()) for r in rows])
    left = {}
    for r in rows:
        data, at, out = r[1].encode(), 0, b""
        for a, b in spans[r[0]]:
            out, at = out + data[at:a], b
        left[r[0]] = (out + data[at:]).decode("utf-8", "ignore")
    assert any(spans.values())
    left = {i: _without_benchmark(t, items) for i, t in left.items() if t.strip()}
    left = {i: t for i, t in left.items() if WORD.search(t)}
    assert {r["doc_id"]: r["text"] for r in got} == left
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert 46 not in left
    assert 47 not in left
    plain = {r["doc_id"]: r["lang"] for r in got if r["doc_id"] < 40 and r["doc_id"] % 5 and r["doc_id"] % 7}
    assert plain == {i: "aa" if i % 3 else "zz" for i in plain}
    # the mix, by the oracle of its operator over what came out of the stage before
    con = duckdb.connect()
    con.execute("CREATE TABLE kept (doc_id BIGINT, source VARCHAR)")
    con.executemany("INSERT INTO kept VALUES (?, ?)", [(r["doc_id"], r["source"]) for r in got])
    want = con.execute(mixing.oracle_sql("kept")).fetchall()
    columns = [d[0] for d in con.description]
    assert sorted(want, key=repr) == sorted((tuple(r[c] for c in columns) for r in got), key=repr)


def test_run_on_an_empty_corpus(spark, tmp_path):
    rows, items = _corpus()
    spark.createDataFrame(rows[:1], "doc_id long, text string, lang string, source string, n_chars long").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
