"""Extraction, language, toxicity, chat, decontamination, mixing, fixity and pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigloom.llm import chat, common, decontaminate, fixity, html_text, language_id, mixing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head &amp; tail</h1><p>One<br>two &lt;3 <b>bold</b></p><p>Three</article><footer>&copy; x</footer>", "Head & tail\n\nOne two <3 bold\n\nThree"),
        ('<body><header><h1>Site</h1><a href=/>Home</a></header><div class="content"><h2>Tit</h2><p>Some text here</p><div class="comments"><p>reader says hello</p></div></div><aside>side</aside><div id="cookie-notice">cookies!</div><form><p>Your mail</p></form>', "Tit\n\nSome text here"),
        ("<article><script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p></article>", "yes"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page, html_text.train())[0] == text


def _words(n, mark="w"):
    return " ".join(f"{mark}{i}" for i in range(n))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>T</h1><p>{_words(80)}</p><p>{_words(80, 'last')}</p></article><nav><a>Home</a></nav>", ["T", _words(80), _words(80, "last")]),
        (f"<article><p>{_words(30)}</p><p class='advert'>Buy now</p><p>One <span class=ad>Buy it</span> two</p><ul><li id=comment-3>reader says</li></ul><p>{_words(9)}</p></article>", [_words(30), "One two", _words(9)]),
        (f"<div><a>Home</a></div><div><a>About us</a></div><div><h2>Title of it</h2><p>{_words(30)}<p>{_words(12)} <a href=x>unclosed<p>{_words(14, 'b')}</div><div><a>x</a></div><div>&copy; me 2020</div>", ["Title of it", _words(30), _words(12) + " unclosed", _words(14, "b")]),
        (f"<form id=page><main class='content no-sidebar'><h1>Head</h1><p>{_words(20)}</p></main></form><form><p>Your mail</p></form>", ["Head", _words(20)]),
        (f"<article><p>{_words(40)}</p><p><a href=q>a linked paragraph between two texts</a></p><p>{_words(50)}</p></article>", [_words(40), "a linked paragraph between two texts", _words(50)]),
        (f"<table><tr><td><a>Home</a><td><a>News</a><tr><td>{_words(60)}<td class=sidebar>{_words(30, 's')}</table>", [_words(60)]),
        (f"<main><p hidden>no</p><p>{_words(12)}<div style='display: none'>no</div><!-- <p>no", [_words(12)]),
    ],
)
def test_main_text_of_other_layouts(page, text):
    assert html_text.main_text(page, html_text.train())[0] == "\n\n".join(text)


def test_tree_asks_for_density_and_neighbours():
    asked = {line.split()[0] for line in html_text.describe(html_text.train()).splitlines() if "<=" in line}
    assert {"words", "link_density", "words_before", "density_before", "words_after"} <= asked


class _Article(HTMLParser):
    """The text of p and h1 elements inside article, for pages of the given form."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [[]]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag == "br" and self.inside:
            self.blocks[-1].append(" ")
        if tag in ("p", "h1"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


def test_main_text_of_given_pages(spark):
    got = {r["page_id"]: r for r in html_text.op1_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        reader = _Article()
        reader.feed(r["html"] or "")
        want = "\n\n".join(t for t in (" ".join("".join(b).split()) for b in reader.blocks) if t)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        ('<article class="post login-form-guide"><h1>How to log in</h1>{}</article>', True),
        ('<article><h1>A title</h1><section class="share-price">{}</section></article>', True),
        ('<article><div class="social-history">{}</div></article>', True),
        ('<article><section class="copyright-law">{}</section></article>', True),
        ('<article><section id="alert-history">{}</section></article>', True),
        ('<form action="/page"><div class="nav-menu"><a href="1">one</a> <a href="2">two</a></div><h1>A title of it</h1>{}</form>', True),
        ('<article><p>{0}</p></article><div class="reader-comments">{1}</div>', False),
        ('<article><p>{0}</p></article><div class="cookie-bar-inner">{1}</div>', False),
        ('<article><p>{0}</p></article><div id="ad-slot-300x250">{1}</div>', False),
        ('<article><p>{0}</p></article><form>{1}</form>', False),
    ],
)
def test_names_do_not_take_articles_away(page, kept):
    body = "<p>" + "word " * 60 + "</p><p>" + "more " * 50 + "</p>"
    made = page.format(body) if kept else page.format("right " * 70, "<p>" + "wrong " * 40 + "</p>")
    text = html_text.main_text(made, html_text.train())[0]
    assert text.count("word") == 60 and text.count("more") == 50 if kept else "wrong" not in text and text.count("right") == 70


def test_extract_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (None, None, None, None)], "page_id long, url string, html string, text int")
    got = html_text.extract(rows).collect()
    assert len(got) == 3
    assert html_text.extract(rows.limit(0)).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    e, a = rng.random((5, 3)) + 0.1, rng.random((3, 3)) + 0.1
    got = language_id.forward_backward(e, np.array([0, 3, 3, 5]), a)
    for lo, hi in ((0, 3), (3, 5)):
        want = np.zeros((hi - lo, 3))
        for path in np.ndindex(*([3] * (hi - lo))):
            w = np.prod([e[lo + t, s] for t, s in enumerate(path)]) * np.prod([a[p, q] for p, q in zip(path, path[1:], strict=False)])
            for t, s in enumerate(path):
                want[t, s] += w
        assert np.allclose(got[lo:hi], want / want.sum(1, keepdims=True))


@pytest.mark.parametrize("block", [1, 3, 7])
def test_long_chains_in_blocks_equal_whole_ones(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    rng = np.random.default_rng(1)
    offsets = np.cumsum([0, 0, 5, 1, 40, 0, 3, 7, 8, 200, 2, 0])
    e, a = np.exp(rng.normal(size=(offsets[-1], 4)) * 4), np.exp(rng.normal(size=(4, 4)) * 2)
    assert np.allclose(language_id.posteriors(e, offsets, a), language_id.forward_backward(e, offsets, a))


def test_a_text_of_many_megabytes(spark):
    """One chain of millions of words takes seconds, not minutes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    text = " ".join(r["text"] for r in docs.filter("lang = 'de'").select("text").limit(100).collect())
    text = text * (8_000_000 // len(text) + 1)
    part = pa.RecordBatch.from_pydict({"text": [text, "kurz"]})
    began = time.perf_counter()
    post, of = language_id._posteriors(model, part)
    assert time.perf_counter() - began < 30
    assert model.languages[int(post[: of[1]].sum(0).argmax())] == "de"


def test_crf_gradient_equals_finite_differences():
    rng = np.random.default_rng(4)
    sample = [("a", "ka lo mi ka"), ("b", "zu ka pe"), ("a", "lo lo"), ("b", "pe zu zu mi ka lo"), ("a", "")]
    c = language_id.chains(sample, ["a", "b"])
    w, t = rng.normal(size=(len(c.used), 2)), rng.normal(size=(2, 2))

    def loss(w, t):
        e = np.exp(np.add.reduceat(w[c.place], c.heads, axis=0)[c.inverse])
        total = 0.0
        for lo, hi in zip(c.offsets, c.offsets[1:], strict=False):
            score = lambda path: np.prod([e[lo + k, s] for k, s in enumerate(path)]) * np.exp(sum(t[p, q] for p, q in zip(path, path[1:], strict=False)))
            total -= np.log(score(c.y[lo:hi])) - np.log(sum(score(path) for path in np.ndindex(*([2] * (hi - lo)))))
        return total / len(c.y)

    gw, gt = language_id.gradient(c, w, t)
    for value, grad in ((w, gw), (t, gt)):
        for at in list(np.ndindex(value.shape))[:12]:
            before = value[at]
            value[at] = before + 1e-5
            up = loss(w, t)
            value[at] = before - 1e-5
            down = loss(w, t)
            value[at] = before
            assert np.isclose(grad[at], (up - down) / 2e-5, atol=1e-6)


def test_language_held_out_and_code_switching(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, ~language_id.held_out())
    got = language_id.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got >= 0.95
    texts = {r["lang"]: " ".join(r["text"].split()[:40]) for r in docs.filter("length(text) > 800").collect()}
    rows = spark.createDataFrame([(1, texts["en"] + " " + texts["de"]), (2, None), (3, "12 ... 34"), (4, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    runs = {r["lang"] for r in language_id.label_runs(rows, model).filter("end - start > 20").collect()}
    assert runs == {"en", "de"}
    named = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(rows, model).collect()}
    assert [named[i] for i in (2, 3, 4)] == [("und", 0.0)] * 3
    empty = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(rows, empty).collect()} == {"und"}


def test_language_sample_counts_texts_not_rows(spark):
    """One text repeated without end, rows without ids, many languages: none is lost."""
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("deutsch wort "), F.col("id")).alias("text"), F.lit("de").alias("lang"))
    rows = rows.union(spark.range(20_000).select(F.lit(1).cast("long"), F.lit("deutsch wort 1"), F.lit("de")))
    rows = rows.union(spark.range(1000).select(F.lit(None).cast("long"), F.concat(F.lit("mot "), F.col("id")), F.lit("fr")))
    rows = rows.union(spark.range(600).select(F.col("id"), F.concat(F.lit("word "), F.col("id")), F.lit("en")))
    rows = rows.union(spark.range(900).select(F.lit(7).cast("long"), F.lit("x y z"), F.concat(F.lit("l"), F.col("id"))))
    counts = {r["lang"]: r["count"] for r in language_id.training_sample(rows).groupBy("lang").count().collect()}
    want = language_id.TRAIN_DOCS_PER_LANGUAGE
    assert counts["de"] == 50
    assert all(0.8 * want < counts[lang] < 1.2 * want for lang in ("fr", "en"))
    assert sum(counts[f"l{i}"] for i in range(900)) == 900


def test_gru_gradients():
    rng = np.random.default_rng(2)
    p = {k: v.astype(float) for k, v in toxicity.start_weights(3).items()}
    x, mask = rng.normal(size=(4, toxicity.INPUTS, 3)), np.array([[1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)
    d = rng.normal(size=3)
    tapes = ([], [])
    _, saved = toxicity.forward(p, x, mask, tapes)
    grad = toxicity.backward(p, x, mask, tapes, saved, d)
    for k in p:
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        want = ((toxicity.forward(up, x, mask)[0] - toxicity.forward(down, x, mask)[0]) * d).sum() / 2e-5
        assert np.isclose(grad[k][at], want, atol=1e-6), k


def test_gru_gradient_of_inputs():
    rng = np.random.default_rng(5)
    p = {k: v.astype(float) for k, v in toxicity.start_weights(3).items()}
    x, mask = rng.normal(size=(3, toxicity.INPUTS, 2)), np.array([[1, 1], [1, 1], [1, 0]], float)
    d, tapes = rng.normal(size=2), ([], [])
    _, saved = toxicity.forward(p, x, mask, tapes)
    got = toxicity.backward(p, x, mask, tapes, saved, d)["x"]
    for at in [(0, 1, 0), (1, toxicity.INPUTS - 1, 1), (2, 0, 0), (2, 3, 1)]:
        up, down = x.copy(), x.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert np.isclose(got[at], ((toxicity.forward(p, up, mask)[0] - toxicity.forward(p, down, mask)[0]) * d).sum() / 2e-5, atol=1e-6)


def test_toxicity_query_and_sample(spark):
    """Every row is scored; the sample is the same whatever the order of repeated rows; long texts are cut."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(80))) for i in range(40)] + [(3, "other text"), (None, "x"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(80)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    one, two = (sorted(tuple(r) for r in toxicity.training_sample(d, labels).collect()) for d in (docs, docs.union(docs).repartition(5)))
    assert one == two
    assert len(one) == 40
    long = " ".join(f"w{k}" for k in range(3 * toxicity.TRAIN_WORDS))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [long, "..."], "toxic": [1, 0]})
    cut = [t for b in toxicity._cut([batch]) for t in b.column("text").to_pylist()]
    assert [len(t.split()) for t in cut] == [toxicity.TRAIN_WORDS, 0]
    assert cut[0] in long
    rows = toxicity.op3_toxicity(spark, SF).collect()
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in given)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_toxicity_windows_cover_all_words():
    index, owner = toxicity.windows(np.array([0, 0, 10, 10 + toxicity.WINDOW * 3 + 5]))
    assert set(index[index >= 0].tolist()) == set(range(10 + toxicity.WINDOW * 3 + 5))
    assert 0 not in owner


def test_toxicity_learns_and_handles_odd_rows(spark):
    rng = random.Random(4)
    clean = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(n))
    sample = [(clean(60), 0) for _ in range(80)] + [(clean(30) + " vile " + clean(30), 1) for _ in range(30)]
    model = toxicity.fit(sample)
    rows = [(i, clean(200) + (" vile " if i % 2 else " ") + clean(200)) for i in range(20)] + [(100, None), (101, ""), (102, "...")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all((got[i] >= 0.7) == bool(i % 2) for i in range(20))
    assert [got[i] for i in (100, 101, 102)] == [0.0] * 3
    assert toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").limit(2), toxicity.fit([])).agg(F.max("score")).first()[0] == 0.0


@pytest.mark.parametrize("text", ["", "a[b\\<c", "[\\", "\\\\[", "<s>[INST] x [/INST]</s>", "[\\[\\<\\"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text


def test_chat_reads_back(spark):
    rows = [(1, 1, "assistant", "yes </s> \n "), (1, 0, "user", " [INST]é"), (1, 2, "tool", None), (1, None, "system", "s"), (1, 1, "assistant", "yes </s> \n "), (2, 0, None, ""), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    want = [("system", "s"), ("user", " [INST]é"), ("assistant", "yes </s> \n "), ("assistant", "yes </s> \n "), ("tool", "")]
    assert chat.parse(out[1]["formatted"]) == want
    loss = "".join(out[1]["formatted"][s["start"] : s["end"]] for s in out[1]["loss_spans"])
    assert chat.unescape(loss) == "yes </s> \n " * 2
    assert len(out[1]["token_ids"]) == len(out[1]["loss_mask"])
    assert chat.digest(chat.format_conversations(df)).count() == 3
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_masked_spans_equal_enumeration():
    rng = random.Random(7)
    for _ in range(200):
        cuts = sorted(rng.sample(range(1, 60), 12))
        starts, ends = np.array([0, *cuts]), np.array([*cuts, 60])
        edges = sorted(rng.sample(range(61), 6))
        spans = [(edges[0], edges[1]), (edges[2], edges[3]), (edges[4], edges[4])]
        wanted = [rng.random() < 0.7 for _ in spans]
        mask, covered = chat.masked_spans(starts, ends, spans, wanted)
        inside = {c for (a, b), w in zip(spans, wanted, strict=True) if w for c in range(a, b)}
        assert mask.tolist() == [any(c in inside for c in range(a, b)) for a, b in zip(starts, ends, strict=True)]
        assert {c for ranges in covered for a, b in ranges for c in range(a, b)} == inside


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = lambda n: [rng.choice("ab cd ef gh ij kl".split()) for _ in range(n)]
    items = [words(14), words(10), ["Zebra", "XRAY"], [], words(25)]
    docs = [words(30) + items[0][2:13] + words(5), words(12), items[4], ["zebra-xray!"], [], ["zebra"], words(300) + items[1]]
    text = lambda w: None if not w else "  ".join(w)
    d = spark.createDataFrame([(i, text(w)) for i, w in enumerate(docs)], "doc_id long, text string").withColumn("terms", F.lit(1))
    b = spark.createDataFrame([(i, text(w)) for i, w in enumerate(items)], "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    want = {}
    for i, w in enumerate(docs):
        own, hit, found = split(text(w)), set(), set()
        for j, x in enumerate(items):
            item = split(text(x))
            n = min(10, len(item))
            for k in range(len(item) - n + 1 if n else 0):
                for s in range(len(own) - n + 1):
                    if own[s : s + n] == item[k : k + n]:
                        hit |= set(range(s, s + n))
                        found.add(str(j))
        want[i] = (len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    for limit in (4_000_000, 60):
        monkeypatch.setattr(decontaminate, "QUERY_WORDS", limit)
        got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.digest(decontaminate.decontaminate(d, b)).collect()}
        assert got == want
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0
    assert decontaminate.digest(decontaminate.decontaminate(d, b.limit(0))).filter("contaminated").count() == 0
    near = decontaminate.proximity(d, [["zebra", "xray"], ["zebra", "nothing"]], 3).collect()
    assert {(r["query"], r["doc_id"]) for r in near} == {(0, 3)}


@pytest.mark.parametrize("limit", [4_000_000, 30])
def test_decontamination_repeated_rows_and_odd_ids(spark, monkeypatch, limit):
    """Equal rows stay rows, of segments of equal shape too; an item_id may hold a comma or be null."""
    monkeypatch.setattr(decontaminate, "QUERY_WORDS", limit)
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 200)
    phrase = "one two three four five six seven eight nine ten"
    rows = [(1, f"a b {phrase} c d")] * 3 + [(2, f"e f {phrase} g h"), (2, "i j k l m n o p"), (None, phrase), (3, None), (4, "of " * 400 + phrase)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([("a,b", phrase), ("c", phrase + " eleven"), (None, phrase), ("c", "ten c d")], "item_id string, text string")
    got = [tuple(r) for r in decontaminate.digest(decontaminate.decontaminate(docs, items)).collect()]
    assert len(got) == len(rows)
    of = lambda *x: hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()
    want = [(1, 14, 12, 3, of("", "a,b", "c"), True)] * 3 + [(2, 14, 10, 3, of("", "a,b", "c"), True), (2, 8, 0, 0, of(), False), (None, 10, 10, 3, of("", "a,b", "c"), True), (3, 0, 0, 0, of(), False), (4, 410, 10, 3, of("", "a,b", "c"), True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_mixing_stays_within_a_block(spark):
    rows = [(i, s) for s, n in (("a", 400), ("b", 90), (None, 60), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit("old"))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    served = {(r["source"], r["block"]): r["slot"] for r in out}
    for r in out:
        assert r["block_release"] <= r["slot"] < r["block_deadline"]
    weight = {r["source"]: r["weight"] for r in out}
    assert sum(weight.values()) == mixing.PERIOD
    last = defaultdict(int)
    for (s, _), t in served.items():
        last[s] = max(last[s], t)
    by = sorted((t, s) for (s, _), t in served.items())
    assert len({t for t, _ in by}) == len(by)
    count = defaultdict(int)
    for t, s in by:
        count[s] += 1
        assert abs(count[s] - (t + 1) * weight[s] / mixing.PERIOD) < 1
    assert mixing.mix(df.limit(0)).count() == 0


def test_fixity_finds_each_damage(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in range(700)] + [(5, "u", None), (5, "u", None)], "page_id long, url string, html string").withColumn("hash", F.lit(1))
    body = F.when(F.col("page_id") == 300, F.lit("x")).otherwise(F.col("html"))
    a, b = fixity.warc_records(pages.filter("page_id <> 41")), fixity.warc_records(pages.filter("page_id <> 699"), body)
    got = {(r["page_id"], r["status"]) for r in fixity.audit(a, b).collect()}
    assert got == {(300, "changed"), (699, "missing"), (41, "extra")}
    assert fixity.audit(a, a).count() == 0
    assert fixity.audit(a.limit(0), b.limit(0)).count() == 0


def test_fixity_of_repeated_and_null_ids(spark):
    """Thousands of records in one slot are one multiset; damage to one of them shows, order does not."""
    rows = [(None, f"u{i}", f"<p>{i}</p>") for i in range(3000)] + [(7, "u", "x")] * 3000 + [(5000, "far", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    a = fixity.warc_records(pages)
    assert fixity.audit(a, fixity.warc_records(pages.repartition(3, "url"))).count() == 0
    body = F.when(F.col("url") == "u17", F.lit("z")).otherwise(F.col("html"))
    got = fixity.audit(a, fixity.warc_records(pages, body)).collect()
    assert [(r["file"], r["slot"], r["page_id"], r["status"]) for r in got] == [(-1, 0, None, "changed")]
    fewer = fixity.audit(a, fixity.warc_records(pages.filter("page_id IS NULL OR page_id <> 5000"))).collect()
    assert [(r["page_id"], r["status"]) for r in fewer] == [(5000, "missing")]
    assert fixity.audit(a.filter("page_id IS NULL"), a.filter("page_id = 5000")).count() == 2


def test_word_hash_tells_words_apart():
    data, offsets = common.text_bytes(pa.array(["Ab ab", None, "é x", "", "ab"]))
    h, start, end, of = common.words(data, offsets, common.SPACED)
    assert of.tolist() == [0, 2, 2, 4, 4, 5]
    assert h[0] == h[1] == h[4]
    assert len({*h.tolist()}) == 3


def test_pipeline_stages(spark):
    passage = "benchmark words one two three four five six seven eight nine"
    long = "Shared passage of much more than one hundred bytes that stands in two documents and has to go from the later one."
    filler = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    letters = lambda k: re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], filler(k))
    rows = [(1, letters(1) + " " + long), (2, letters(2) + " " + long), (3, letters(3) + " " + passage + " tail"), (4, letters(4)), (5, letters(4)), (6, "123 456"), (7, None), (8, passage)]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()} == {1, 2, 3, 4, 5, 8}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {1, 2, 3, 4, 6, 7, 8}
    cut = {r["doc_id"]: r for r in corpus_pipeline.suffix_cut(spark, docs, SF).collect()}
    assert set(cut) == {1, 2, 3, 4, 6, 8}
    assert long not in cut[2]["text"]
    assert long in cut[1]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())
    mixed = corpus_pipeline.mixture(spark, docs, SF)
    assert mixed.count() == 8
    assert corpus_pipeline.without_spans("A b, c d!", [{"start": 1, "end": 3}]) == "A d!"
    out = corpus_pipeline.decontamination(spark, docs, SF)
    assert out.columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize(("large", "small"), [(50, 50), (3, 598)])
def test_mixing_takes_any_number_of_sources(spark, large, small):
    sizes = {f"s{i:03d}": 40 if i < large else 1 for i in range(large + small)} | {None: 2}
    if large == 50:
        sizes = {s: n * 250 if n > 1 else n for s, n in sizes.items() if s}
    df = spark.createDataFrame(list(sizes.items()), "source string, n int").select("source", F.explode(F.sequence(F.lit(1), "n")).alias("doc_id"))
    out = mixing.mix(df).collect()
    assert len(out) == sum(sizes.values())
    weight = {r["source"]: r["weight"] for r in out}
    assert min(weight.values()) >= 1
    assert sum(weight.values()) == mixing.slots(len(sizes))
    assert all(r["block_release"] <= r["slot"] < r["block_deadline"] for r in out)
    by = {r["slot"]: (r["source"], r["block"]) for r in out}
    assert len(by) == len(set(by.values())) == len({(r["source"], r["block"]) for r in out})
    assert {s for s in sizes if weight[s] > 1} >= {s for s, n in sizes.items() if n > 2}


@pytest.mark.parametrize("missing", ["c", None])
def test_mixing_refuses_a_source_without_weight(spark, missing):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["a", "b", missing] * 20)], "doc_id long, source string")
    some = [("a", 140), ("b", 100)]
    with pytest.raises(Exception, match="no weight"):
        mixing.mix(df, spark.createDataFrame(some, "source string, weight long")).collect()
    every = spark.createDataFrame([("a", 100), ("b", 100), (missing, 40)], "source string, weight long")
    assert mixing.mix(df, every).count() == 60
