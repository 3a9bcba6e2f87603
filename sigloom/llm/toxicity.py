"""Toxicity with a bidirectional gated recurrent network and attention pooling.

A word enters the network with a learned embedding of the word, the mean of learned
embeddings of its character n-grams, and four numbers: the log odds of the word, the
largest and the mean log odds of its n-grams, and whether the word was seen in fitting.
Two recurrent passes (forward and backward) read every window of WINDOW words, windows
overlap by WINDOW-STRIDE, attention pools the states of a window into one logit, and a
document has the largest logit of all its windows, calibrated to a probability.

Everything is learned from a bounded sample of labelled documents (TRAIN_TOXIC and
TRAIN_CLEAN at most, chosen by hash; of a longer text TRAIN_WORDS words from a hashed
place), in one task; the driver sees the model alone.  In fitting, a document's own words
are left out of the counts behind their log odds, so the network sees what it will see on
new texts; words of fewer than OFTEN documents have no embedding of their own.

Defined cases: null text and text without words score 0; without labelled rows of both
classes all scores are 0; several labels of a document count as toxic if one is; a null
label is no label; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, mix, slices, text_bytes, words

TRAIN_TOXIC = 1500
TRAIN_CLEAN = 3000
TRAIN_WORDS = 5000
CLEAN_WINDOWS = 3  # of a clean text, its most suspect ones; of a toxic text the most suspect one
WINDOW, STRIDE = 48, 32
NUMBERS, EMBEDDING = 4, 4
HIDDEN, INPUTS, ATTENTION = 8, NUMBERS + 2 * EMBEDDING, 8
TABLE_BITS = 15  # rows of an embedding table
OFTEN = 4
DECAY, KEPT = 5e-4, 0.3  # of embeddings: weight decay, and share of windows that have them in a round
GRAM_BITS = 18
GRAMS = (3, 4, 5)
SMOOTH = 1.0
BAR = 0.7


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    word_odds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    gram_odds: np.ndarray = field(default_factory=lambda: np.zeros(1 << GRAM_BITS, np.float32))
    often: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # words with an embedding
    tables: dict = field(default_factory=dict)  # embeddings of words and of n-grams
    weights: dict = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0


def gram_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of each word with a boundary byte on both sides; first gram of each word."""
    size = end - start + 2
    heads = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(owner)) - heads[owner]
    inner = (at > 0) & (at < size[owner] - 1)
    chars = np.ones(len(owner), np.uint64)
    chars[inner] = data[(start[owner] + at - 1)[inner]].astype(np.uint64) + np.uint64(2)
    left, gram, ids, valid = size[owner] - at, np.zeros(len(owner), np.uint64), [], []
    for n in range(1, GRAMS[-1] + 1):
        ahead = np.zeros(len(owner), np.uint64)
        ahead[: max(0, len(owner) - n + 1)] = chars[n - 1 :]
        gram = gram * np.uint64(0x100000001B3) + ahead
        if n in GRAMS:
            ids.append((mix(gram + np.uint64(n)) >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
            valid.append((left >= n) | ((at == 0) & (n == GRAMS[0])))
    keep = np.stack(valid, 1)
    return np.stack(ids, 1)[keep], np.concatenate(([0], np.cumsum(keep.sum(1))[:-1]))[heads]


def _odds(one: np.ndarray, zero: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Smoothed towards the classes' own odds, so that a rare word has log odds near 0."""
    prior = n1 / (n1 + n0)
    rate1, rate0 = (one + SMOOTH * prior) / n1, (zero + SMOOTH * (1 - prior)) / n0
    return np.clip(np.log(rate1) - np.log(rate0), -3, 6).astype(np.float32)


def _numbers(word_odds: np.ndarray, seen: np.ndarray, grams: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """NUMBERS numbers for each word."""
    if not len(heads):
        return np.zeros((0, NUMBERS), np.float32)
    count = np.diff(np.append(heads, len(grams)))
    return np.stack([word_odds, np.maximum.reduceat(grams, heads), np.add.reduceat(grams, heads) / count, seen], 1).astype(np.float32)


def _rows(h: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Row of each word in the table of word embeddings; the last row is that of words without one."""
    return np.where(often, (mix(h ^ np.uint64(0x6C62272E07BB0142)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), 1 << TABLE_BITS)


def _embedded(tables: dict, rows: np.ndarray, grams: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Embedding of each word, and the mean embedding of its n-grams."""
    if not len(heads):
        return np.zeros((0, 2 * EMBEDDING), np.float32)
    count = np.diff(np.append(heads, len(grams)))[:, None]
    mean = np.add.reduceat(tables["grams"][grams >> (GRAM_BITS - TABLE_BITS)], heads, axis=0) / count
    return np.concatenate((tables["words"][rows], mean), axis=1).astype(np.float32)


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows: word indices (windows x WINDOW, -1 beyond the text) and their text."""
    count = np.diff(offsets)
    n = np.where(count > 0, np.maximum(0, -(-(count - WINDOW) // STRIDE)) + 1, 0)
    owner = np.repeat(np.arange(len(count)), n)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    at = first[:, None] + np.arange(WINDOW)
    return np.where(at < count[owner][:, None], at + offsets[:-1][owner][:, None], -1), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _pass(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, order: range, tape: list | None = None) -> np.ndarray:
    """One recurrent pass. x: steps x INPUTS x windows; mask: steps x windows; states: steps x HIDDEN x windows."""
    steps, _, n = x.shape
    h, out, k = np.zeros((HIDDEN, n), x.dtype), np.empty((steps, HIDDEN, n), x.dtype), HIDDEN
    for t in order:
        a = w @ x[t]
        a += b[:, None]
        c = u @ h
        gate = _sigmoid(a[: 2 * k] + c[: 2 * k])
        r, z = gate[:k], gate[k:]
        new = np.tanh(a[2 * k :] + r * c[2 * k :])
        keep = mask[t] * (1 - z)
        if tape is not None:
            tape.append((t, h, r, z, c[2 * k :], new))
        h = h + keep * (new - h)
        out[t] = h
    return out


def forward(p: dict, x: np.ndarray, mask: np.ndarray, tapes: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """Logits of windows and what backward() needs."""
    steps = len(x)
    f = _pass(x, mask, p["wf"], p["uf"], p["bf"], range(steps), tapes and tapes[0])
    g = _pass(x, mask, p["wb"], p["ub"], p["bb"], range(steps - 1, -1, -1), tapes and tapes[1])
    h = np.concatenate((f, g), axis=1)
    e = np.tanh(np.einsum("ah,thn->tan", p["ua"], h, optimize=True))
    s = np.einsum("a,tan->tn", p["va"], e, optimize=True)
    s = np.where(mask > 0, s, -1e4)
    s = np.exp(s - s.max(0))
    s /= s.sum(0)
    pooled = np.einsum("tn,thn->hn", s, h, optimize=True)
    return p["wo"] @ pooled + p["bo"], (h, e, s, pooled)


def backward(p: dict, x: np.ndarray, mask: np.ndarray, tapes: tuple, saved: tuple, d: np.ndarray) -> dict:
    """Gradients of sum(d * logit), in the weights and the inputs x."""
    h, e, s, pooled = saved
    out = {"wo": pooled @ d, "bo": d.sum()}
    dp = p["wo"][:, None] * d
    dh = s[:, None] * dp[None]
    ds = np.einsum("hn,thn->tn", dp, h, optimize=True)
    ds = s * (ds - (s * ds).sum(0))
    out["va"] = np.einsum("tn,tan->a", ds, e, optimize=True)
    de = ds[:, None] * p["va"][None, :, None] * (1 - e * e)
    out["ua"] = np.einsum("tan,thn->ah", de, h, optimize=True)
    dh += np.einsum("ah,tan->thn", p["ua"], de, optimize=True)
    k = HIDDEN
    out["x"] = np.zeros_like(x)
    for side, tape, part in (("f", tapes[0], slice(0, k)), ("b", tapes[1], slice(k, 2 * k))):
        w, u = np.zeros_like(p["w" + side]), np.zeros_like(p["u" + side])
        b, carry = np.zeros_like(p["b" + side]), np.zeros_like(dh[0, part])
        for t, before, r, z, cn, new in reversed(tape):
            g = carry + dh[t, part]
            m = mask[t]
            dn = g * m * (1 - z) * (1 - new * new)
            dz = -g * m * (new - before) * z * (1 - z)
            dr = dn * cn * r * (1 - r)
            da = np.concatenate((dr, dz, dn))
            dc = np.concatenate((dr, dz, dn * r))
            w += da @ x[t].T
            out["x"][t] += p["w" + side].T @ da
            b += da.sum(1)
            u += dc @ before.T
            carry = g * (1 - m * (1 - z)) + p["u" + side].T @ dc
        out |= {"w" + side: w, "u" + side: u, "b" + side: b}
    return out


def start_weights(seed: int = 11) -> dict:
    rng = np.random.default_rng(seed)
    k = HIDDEN
    p = {"ua": rng.normal(0, 0.3, (ATTENTION, 2 * k)), "va": rng.normal(0, 0.3, ATTENTION), "wo": rng.normal(0, 0.3, 2 * k), "bo": np.zeros(())}
    for side in "fb":
        p |= {"w" + side: rng.normal(0, 0.3, (3 * k, INPUTS)), "u" + side: rng.normal(0, 0.2, (3 * k, k)), "b" + side: np.zeros(3 * k)}
    return p


def _laid(inputs: np.ndarray, index: np.ndarray, dtype: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (steps x INPUTS x windows) and mask (steps x windows) of windows."""
    padded = np.vstack((inputs, np.zeros((1, inputs.shape[1]), inputs.dtype)))
    return np.ascontiguousarray(padded[index.T].transpose(0, 2, 1), dtype), (index.T >= 0).astype(dtype)


def _read(texts: list[str], step: int = 128) -> tuple[np.ndarray, ...]:
    """Word hashes and offsets of texts; distinct words, their n-grams and each word's first n-gram.

    A few texts at a time, so that the driver never holds byte tables of the whole sample.
    """
    h, count, names, grams, sizes = ([] for _ in range(5))
    for lo in range(0, len(texts), step):
        data, offsets = text_bytes(pc.utf8_lower(pa.array(texts[lo : lo + step], pa.string())))
        own, start, end, of = words(data, offsets, ALNUM)
        h.append(own)
        count.append(np.diff(of))
        distinct, first = np.unique(own, return_index=True)
        if len(distinct):
            ids, heads = gram_ids(data, start[first], end[first])
            names.append(distinct)
            grams.append(ids)
            sizes.append(np.diff(np.append(heads, len(ids))))
    of = np.concatenate(([0], np.cumsum(np.concatenate(count))))
    if not names:
        return np.zeros(0, np.uint64), of, np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    size, ids = np.concatenate(sizes), np.concatenate(grams)
    vocabulary, first = np.unique(np.concatenate(names), return_index=True)
    many = size[first]
    heads = np.cumsum(many) - many
    at = np.repeat((np.cumsum(size) - size)[first], many) + np.arange(many.sum()) - np.repeat(heads, many)
    return np.concatenate(h), of, vocabulary, ids[at], heads


def _gram_counts(pair: np.ndarray, grams: np.ndarray, heads: np.ndarray, y: np.ndarray, step: int = 64) -> np.ndarray:
    """How many documents of label 1 and 0 hold each n-gram; a few documents at a time. pair: (word, document) by document."""
    size, out = np.diff(np.append(heads, len(grams))), np.zeros((2, 1 << GRAM_BITS))
    for lo in range(0, len(y), step):
        some = pair[np.searchsorted(pair[:, 1], lo) : np.searchsorted(pair[:, 1], lo + step)]
        many = size[some[:, 0]]
        at = np.repeat(heads[some[:, 0]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        held = np.unique(grams[at].astype(np.int64) * len(y) + np.repeat(some[:, 1], many))
        for k in (0, 1):
            out[1 - k] += np.bincount(held // len(y), y[held % len(y)] == k, 1 << GRAM_BITS)
    return out


def _step(value: np.ndarray, grad: np.ndarray, moments: tuple[np.ndarray, np.ndarray], r: int, rate: float) -> None:
    """One step of Adam, in place."""
    u, v = moments
    u += 0.1 * (grad - u)
    v += 0.01 * (grad * grad - v)
    value -= rate * (u / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)


def fit(sample: list[tuple[str, int]], rounds: int = 45, rate: float = 0.03) -> Model:
    """Model from (text, label) rows."""
    y = np.array([label for _, label in sample], np.int64)
    n1, n0 = float(y.sum()), float((1 - y).sum())
    if not n1 or not n0:
        return Model()
    h, of, vocabulary, grams, heads = _read([t for t, _ in sample])
    inverse = np.searchsorted(vocabulary, h).astype(np.int32)
    doc = np.repeat(np.arange(len(sample), dtype=np.int32), np.diff(of))
    key = np.unique(inverse.astype(np.int64) * len(sample) + doc)
    pair = np.stack((key // len(sample), key % len(sample)), 1)
    one = np.bincount(pair[:, 0], y[pair[:, 1]], len(vocabulary))
    zero = np.bincount(pair[:, 0], 1 - y[pair[:, 1]], len(vocabulary))
    gram_one, gram_zero = _gram_counts(pair[np.argsort(pair[:, 1], kind="stable")], grams, heads, y)
    del key, pair
    model = Model(vocabulary, _odds(one, zero, n1, n0), _odds(gram_one, gram_zero, n1, n0), one + zero >= OFTEN)
    rng, rows = np.random.default_rng(13), _rows(vocabulary, model.often)
    model.tables = {k: rng.normal(0, 0.1, (n, EMBEDDING)).astype(np.float32) for k, n in (("words", (1 << TABLE_BITS) + 1), ("grams", 1 << TABLE_BITS))}
    model.tables["words"][-1] = 0
    # inputs with the document's own label left out of the counts
    own = []
    for a, b in ((0, 1), (1, 0)):
        counts = [np.maximum(c, 0) for c in (one - a, zero - b, gram_one - a, gram_zero - b)]
        own.append(_numbers(_odds(counts[0], counts[1], n1, n0), (one + zero > 1).astype(np.float32), _odds(counts[2], counts[3], n1, n0)[grams], heads))
    x_words = np.stack(own)[y[doc], inverse]
    index, owner = windows(of)
    suspect = np.append(np.clip(x_words[:, 0], 0, None), np.float32(0))
    value = np.concatenate([suspect[index[lo : lo + 4096]].sum(1) for lo in range(0, len(index), 4096)] or [suspect[:0]])
    order = np.lexsort((-value, owner))
    rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order], "left")
    chosen = order[rank < np.where(y[owner[order]] == 1, 1, CLEAN_WINDOWS)]
    x, mask = _laid(x_words, index[chosen])
    word = np.where(index[chosen] >= 0, inverse[np.maximum(index[chosen], 0)], len(vocabulary)).T  # steps x windows
    t = y[owner[chosen]].astype(np.float32)
    weight = np.where(t == 1, 0.5 / t.sum(), 0.5 / (1 - t).sum()).astype(np.float32)
    p = {k: v.astype(np.float32) for k, v in start_weights().items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (p | model.tables).items()}
    size, many = len(vocabulary), np.diff(np.append(heads, len(grams)))
    for r in range(1, rounds + 1):
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        embedded = np.vstack((_embedded(model.tables, rows, grams, heads), np.zeros((1, 2 * EMBEDDING), np.float32)))
        back = np.zeros((2 * EMBEDDING, size + 1))  # gradient of each word's embeddings
        for lo in range(0, len(t), 1024):
            part = slice(lo, lo + 1024)
            tapes: tuple = ([], [])
            # embeddings are left out of most windows by chance, so that the network does not learn texts by heart
            keep = (rng.random(mask[:, part].shape[1]) < KEPT).astype(np.float32) / KEPT
            whole = np.concatenate((x[:, :, part], embedded[word[:, part]].transpose(0, 2, 1) * keep), axis=1).astype(np.float32)
            logit, saved = forward(p, whole, mask[:, part], tapes)
            d = weight[part] * (1 / (1 + np.exp(-logit)) - t[part]).astype(np.float32)
            found = backward(p, whole, mask[:, part], tapes, saved, d)
            for k in p:
                grad[k] = grad[k] + found[k]
            for j in range(2 * EMBEDDING):
                back[j] += np.bincount(word[:, part].ravel(), (found["x"][:, NUMBERS + j] * keep).ravel(), size + 1)
        for k in p:
            value = np.asarray(p[k])
            _step(value, grad[k] + 1e-4 * value, moments[k], r, rate)
            p[k] = value
        by_word = [np.bincount(rows, back[j, :-1], (1 << TABLE_BITS) + 1) for j in range(EMBEDDING)]
        by_gram = [np.bincount(grams >> (GRAM_BITS - TABLE_BITS), np.repeat(back[EMBEDDING + j, :-1] / many, many), 1 << TABLE_BITS) for j in range(EMBEDDING)]
        for k, g in (("words", by_word), ("grams", by_gram)):
            _step(model.tables[k], np.stack(g, 1).astype(np.float32) + DECAY * model.tables[k], moments[k], r, rate / 10)
        model.tables["words"][-1] = 0
    model.weights = {k: np.asarray(v, np.float32) for k, v in p.items()}
    embedded = _embedded(model.tables, rows, grams, heads)
    best = document_logits(model.weights, np.concatenate((x_words.astype(np.float32), embedded[inverse]), axis=1), of)
    some = np.isfinite(best)
    a, b = 1.0, 0.0
    for _ in range(200):  # calibrate by logistic regression on the largest logit
        q = 1 / (1 + np.exp(-(a * best[some] + b)))
        g = q - y[some]
        w = np.maximum(q * (1 - q), 1e-4)
        ga, gb = (g * best[some]).mean() + 1e-3 * (a - 1), g.mean()
        haa, hab, hbb = (w * best[some] ** 2).mean() + 1e-3, (w * best[some]).mean(), w.mean()
        det = haa * hbb - hab * hab + 1e-9
        a, b = a - 0.5 * (hbb * ga - hab * gb) / det, b - 0.5 * (haa * gb - hab * ga) / det
    model.slope, model.shift = float(a), float(b)
    return model


def document_logits(weights: dict, inputs: np.ndarray, offsets: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """Largest window logit of each text; -inf without words."""
    index, owner = windows(offsets)
    out = np.full(len(offsets) - 1, -np.inf)
    for lo in range(0, len(index), chunk):
        x, mask = _laid(inputs, index[lo : lo + chunk])
        np.maximum.at(out, owner[lo : lo + chunk], forward(weights, x, mask)[0].astype(float))
    return out


def text_inputs(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.string())))
    h, start, end, of = words(data, offsets, ALNUM)
    distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    if not len(distinct):
        return np.zeros((0, INPUTS), np.float32), of
    grams, heads = gram_ids(data, start[first], end[first])
    at = np.minimum(np.searchsorted(model.words, distinct), len(model.words) - 1)
    seen = model.words[at] == distinct
    # a word that was not seen has the odds of zero counts, as in fitting
    numbers = _numbers(np.where(seen, model.word_odds[at], 0), seen, model.gram_odds[grams], heads)
    embedded = _embedded(model.tables, _rows(distinct, seen & model.often[at]), grams, heads)
    return np.concatenate((numbers, embedded), axis=1)[inverse], of


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of at most TRAIN_WORDS words; of a longer one so many words from a hashed place."""
    for batch in batches:
        for part in slices(batch):
            data, offsets = text_bytes(pc.utf8_lower(part.column("text").cast(pa.string())))
            _, start, end, of = words(data, offsets, ALNUM)
            out = []
            for i, n in enumerate(np.diff(of).tolist()):
                take = min(n, TRAIN_WORDS)
                first = of[i] + zlib.crc32(data[offsets[i] : offsets[i + 1]].tobytes()) % (n - take + 1)
                out.append(data[start[first] : end[first + take - 1]].tobytes().decode() if take else "")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string()), part.column("toxic")], names=["doc_id", "text", "toxic"])


def training_sample(documents: DataFrame, labels: DataFrame, rule: F.Column | None = None) -> DataFrame:
    """(text, toxic): cut texts of at most TRAIN_TOXIC and TRAIN_CLEAN labelled documents, chosen by hash."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = (rows.filter(rule) if rule is not None else rows).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    parts = [rows.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    # at most TRAIN_TOXIC + TRAIN_CLEAN rows of two numbers
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    found = documents.filter(F.col("text").isNotNull()).join(chosen, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic")
    # an id has one text in the sample, whatever its rows
    one = found.mapInArrow(_cut, "doc_id long, text string, toxic int").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return one.select("text", "toxic")


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sample = [row for b in batches for row in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True)]
    yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(sorted(sample)))]}, pa.schema([("model", pa.binary())]))


def train(documents: DataFrame, labels: DataFrame, rule: F.Column | None = None) -> Model:
    """Model fitted in one task to the bounded sample."""
    found = training_sample(documents, labels, rule).repartition(1).mapInArrow(_fit_rows, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Model()


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_words) of every row of documents."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch):
                if model.weights:
                    inputs, of = text_inputs(model, part.column("text"))
                    logit = document_logits(model.weights, inputs, of)
                    with np.errstate(over="ignore"):
                        value = np.where(np.isfinite(logit), 1 / (1 + np.exp(-(model.slope * logit + model.shift))), 0.0)
                    count = np.diff(of)
                else:
                    value, count = np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value, pa.float64()), pa.array(count, pa.int64())], names=["doc_id", "score", "n_words"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_words long")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs.select("doc_id", "text"), labels, ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= BAR).cast("int").alias("predicted"), "n_words")
