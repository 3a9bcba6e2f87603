"""Language identification with a linear-chain conditional random field over words.

Each word is an item of a chain.  Its emission score per language is the sum of
learned weights of its features: prefixes and suffixes (n-grams that touch a word
boundary), inner character n-grams, and the whole word (lexicon).  Transitions
between the languages of neighbouring words are learned as well, so that
code-switched text is labelled word by word with forward-backward.  A document's
language is the one with the largest sum of word posteriors.

Fitting takes a bounded sample: about TRAIN_DOCS_PER_LANGUAGE documents a language,
at most TRAIN_WORDS words from each, read from a hashed place.  Executors cut the
texts, one task fits the cut words (at most languages x documents x words of them),
and the driver sees the model alone.  Prediction reads whole texts.

Defined cases: null text or text without a letter is `und` with score 0; without
any labelled document everything is `und`; repeated rows are predicted each; ties
go to the language first in sorted order; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, slices, text_bytes, words

LANGUAGES_SENT = 10_000  # with a number each
TRAIN_DOCS_PER_LANGUAGE = 400
TRAIN_WORDS = 120
BLOCK = 2048  # words of a long chain that are taken one behind the other
NGRAMS = 4
TABLE_BITS = 18
SLICE = 4 << 20

LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # languages x languages, log scale


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of each word and first feature of each word (for reduceat).

    Words are laid out with a boundary byte on both sides, so an n-gram with a
    boundary is an affix feature; the last feature of a word is the word itself.
    """
    size = end - start + 2
    heads = np.cumsum(size) - size
    total = int(size.sum())
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(total) - heads[owner]
    inner = (at > 0) & (at < size[owner] - 1)
    chars = np.ones(total, np.uint64)
    chars[inner] = data[(start[owner] + at - 1)[inner]].astype(np.uint64) + np.uint64(2)
    left = size[owner] - at  # bytes from here to the end of the word
    mask = np.uint64((1 << TABLE_BITS) - 1)
    gram, columns, valid = np.zeros(total, np.uint64), [], []
    for n in range(1, NGRAMS + 1):
        ahead = np.zeros(total, np.uint64)
        ahead[: max(0, total - n + 1)] = chars[n - 1 :]
        gram = gram * np.uint64(0x100000001B3) + ahead
        columns.append(mix(gram + np.uint64(n)) >> np.uint64(20) & mask)
        valid.append(left >= n)
    columns.append(mix(h ^ np.uint64(0x5851F42D4C957F2D))[owner] & mask)
    valid.append(at == 0)
    ids = np.stack(columns, 1).astype(np.int32)
    keep = np.stack(valid, 1)
    count = keep.sum(1)
    return ids[keep], np.concatenate(([0], np.cumsum(count)[:-1]))[heads]


def emissions(model_weights: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Emission scores of all words, computed once for each distinct word."""
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    ids, heads = word_features(data, start[first], end[first], h[first])
    return np.add.reduceat(model_weights[ids], heads, axis=0)[inverse]


def forward_backward(e: np.ndarray, offsets: np.ndarray, a: np.ndarray, pairs: np.ndarray | None = None, into: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Posteriors of each word. e: scores > 0, words x languages; offsets: words of each chain.

    The expected transitions (sums of pairwise marginals) of all chains are added to pairs.
    into, after: for chains that are parts of longer ones, the messages that reach their first word and their last.
    """
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    begin, length = offsets[:-1][order], length[order]
    active = len(length) - np.searchsorted(length[::-1], np.arange(1, (length[0] if len(length) else 0) + 1), "left")
    alpha = np.empty_like(e)
    x = np.full((len(length), e.shape[1]), 1.0 / e.shape[1], e.dtype) if into is None else into[order]
    for t, m in enumerate(active.tolist()):
        at = begin[:m] + t
        x = e[at] * (x[:m] @ a if t else x[:m])
        x /= x.sum(1, keepdims=True)
        alpha[at] = x
    y = np.ones((len(length), e.shape[1]), e.dtype) if after is None else after[order]
    for t in range(len(active) - 1, -1, -1):
        m = int(active[t])
        at = begin[:m] + t
        ahead = e[at] * y[:m]
        if pairs is not None and t:
            before = alpha[at - 1]
            pairs += a * ((before / ((before @ a) * ahead).sum(1, keepdims=True)).T @ ahead)
        alpha[at] *= y[:m]
        z = ahead @ a.T
        y[:m] = z / z.sum(1, keepdims=True)
    return alpha / alpha.sum(1, keepdims=True)


def posteriors(e: np.ndarray, offsets: np.ndarray, a: np.ndarray) -> np.ndarray:
    """forward_backward() with long chains cut into blocks of BLOCK words that advance side by side.

    A block's words multiply to one languages x languages matrix; these, in order, give the messages that reach each
    block from both sides, and with them the blocks are chains of their own.  The result is the same."""
    length = np.diff(offsets)
    if not len(length) or length.max() <= BLOCK:
        return forward_backward(e, offsets, a)
    k, cuts = e.shape[1], [np.arange(0, max(1, n), BLOCK) for n in length.tolist()]
    chain = np.repeat(np.arange(len(length)), [len(c) for c in cuts])
    begin = offsets[:-1][chain] + np.concatenate(cuts)
    edges = np.append(begin, offsets[-1])
    first = np.concatenate(([True], chain[1:] != chain[:-1]))
    parts = np.flatnonzero(length[chain] > BLOCK)
    parts = parts[np.argsort(-np.diff(edges)[parts], kind="stable")]
    size = np.diff(edges)[parts]
    product = np.where(first[parts][:, None, None], np.eye(k), a.astype(float))
    for t in range(int(size[0])):
        m = int(np.searchsorted(-size, -t, "left"))  # blocks of more than t words
        step = product[:m] @ a if t else product[:m]
        step = step * e[begin[parts[:m]] + t][:, None, :]
        product[:m] = step / step.max((1, 2), keepdims=True)
    into, after = np.full((len(chain), k), 1.0 / k, e.dtype), np.ones((len(chain), k), e.dtype)
    order = np.argsort(parts)
    parts, product = parts[order], product[order]
    f = np.ones(k) / k
    for i, p in enumerate(parts.tolist()):
        f = np.ones(k) / k if first[p] else f
        into[p] = f if first[p] else f @ a
        f = f @ product[i]
        f /= f.sum()
    for i in range(len(parts) - 1, -1, -1):
        p = int(parts[i])
        y = np.ones(k) if i == len(parts) - 1 or first[parts[i + 1]] else y / y.sum() * k
        after[p] = y
        y = product[i] @ y
    return forward_backward(e, edges, a, None, into, after)


def _scores(logits: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(logits - logits.max(1, keepdims=True), -30)).astype(np.float32)


@dataclass
class Chains:
    """The fitting sample as chains: distinct words with their features, and each word's language."""

    inverse: np.ndarray  # distinct word of each word
    place: np.ndarray  # feature numbers of the distinct words
    heads: np.ndarray  # first feature of each distinct word
    owner: np.ndarray  # distinct word of each feature
    used: np.ndarray  # feature of each feature number
    y: np.ndarray
    offsets: np.ndarray
    observed: np.ndarray  # transitions


def chains(sample: list[tuple[str, str]], languages: list[str]) -> Chains | None:
    """Chains spliced from runs of 20 words of several documents, so that languages change within them."""
    k = len(languages)
    data, offsets = text_bytes(pc.utf8_lower(pa.array([t for _, t in sample], pa.string())))
    h, start, end, of = words(data, offsets, LETTERS)
    pieces, gold = [], []
    for i, (lang, _) in enumerate(sample):
        for p in range(of[i], of[i + 1], 20):
            pieces.append(np.arange(p, min(p + 20, of[i + 1])))
            gold.append(languages.index(lang))
    if not pieces:
        return None
    turn = np.random.default_rng(7).permutation(len(pieces))
    index = np.concatenate([pieces[j] for j in turn])
    y = np.repeat(np.array(gold)[turn], [len(pieces[j]) for j in turn])
    ends = np.cumsum([len(pieces[j]) for j in turn])
    bounds = np.concatenate(([0], np.append(ends[3:-1:4], ends[-1])))
    distinct, first, inverse = np.unique(h[index], return_index=True, return_inverse=True)
    ids, heads = word_features(data, start[index][first], end[index][first], distinct)
    inside = np.ones(len(index), bool)
    inside[bounds[:-1]] = False
    observed = np.zeros((k, k))
    np.add.at(observed, (y[:-1][inside[1:]], y[1:][inside[1:]]), 1)
    used, place = np.unique(ids, return_inverse=True)
    owner = np.repeat(np.arange(len(distinct)), np.diff(np.append(heads, len(ids))))
    return Chains(inverse, place, heads, owner, used, y, bounds, observed)


def gradient(c: Chains, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean negative log likelihood a word, in feature weights and transitions."""
    k = len(t)
    e = _scores(np.add.reduceat(w[c.place], c.heads, axis=0)[c.inverse]).astype(float)
    expected = np.zeros((k, k))
    left = forward_backward(e, c.offsets, np.exp(t - t.max()), expected) - np.eye(k)[c.y]
    per_word = np.stack([np.bincount(c.inverse, left[:, j], len(c.heads)) for j in range(k)], 1)
    g = np.stack([np.bincount(c.place, per_word[c.owner, j], len(c.used)) for j in range(k)], 1)
    return g / len(c.y), (expected - c.observed) / len(c.y)


def fit(sample: list[tuple[str, str]], rounds: int = 40, rate: float = 0.15) -> Model:
    """CRF by maximum likelihood (full-batch Adam) from (lang, text) rows."""
    languages = sorted({lang for lang, _ in sample})
    k = len(languages)
    model = Model(languages, np.zeros((1 << TABLE_BITS, k), np.float32), np.log(np.full((k, k), 0.05) + np.eye(k) * 0.9))
    c = chains(sample, languages) if k else None
    if c is None:
        return model
    w, m1, m2 = (np.zeros((len(c.used), k)) for _ in range(3))
    t, t1, t2 = model.transitions, np.zeros((k, k)), np.zeros((k, k))
    for r in range(1, rounds + 1):
        g, gt = gradient(c, w, t)
        for value, grad, u, v in ((w, g + 1e-6 * w, m1, m2), (t, gt, t1, t2)):
            u += 0.1 * (grad - u)
            v += 0.02 * (grad * grad - v)
            value -= rate * (u / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.98**r)) + 1e-7)
    model.weights[c.used] = w
    return model


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text, lower-cased, at most TRAIN_WORDS words from a hashed place."""
    for batch in batches:
        for part in slices(batch):
            data, offsets = text_bytes(pc.utf8_lower(part.column("text").cast(pa.string())))
            _, start, end, of = words(data, offsets, LETTERS)
            out = []
            for i, n in enumerate(np.diff(of).tolist()):
                take = min(n, TRAIN_WORDS)
                first = of[i] + zlib.crc32(data[offsets[i] : offsets[i + 1]].tobytes()) % (n - take + 1)
                out.append(data[start[first] : end[first + take - 1]].tobytes().decode() if take else "")
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(out, pa.string())], names=["lang", "text"])


def training_sample(documents: DataFrame, rule: F.Column | None = None) -> DataFrame:
    """(lang, text): cut texts of about TRAIN_DOCS_PER_LANGUAGE different texts a language, chosen by the text's hash.

    Repeats of a text count once and are chosen together, whatever their ids; a language with fewer texts gives all."""
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.filter(rule) if rule is not None else rows
    span = 1 << 62
    place = F.xxhash64("text").bitwiseAND(F.lit(span - 1))
    share = F.lit(float(span)) * TRAIN_DOCS_PER_LANGUAGE / F.approx_count_distinct(place, 0.02)
    bars = rows.groupBy("lang").agg(F.least(F.lit(float(span)), share).cast("long").alias("bar"))
    few = bars.limit(LANGUAGES_SENT + 1).collect()
    if len(few) <= LANGUAGES_SENT:  # else Spark shuffles texts by language
        bars = F.broadcast(documents.sparkSession.createDataFrame(few, bars.schema))
    picked = rows.select("lang", "text").join(bars, "lang").filter(place < F.col("bar")).select("lang", "text").distinct()
    return picked.mapInArrow(_cut, "lang string, text string")


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sample = [row for b in batches for row in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True)]
    model = fit(sorted(sample))
    yield pa.RecordBatch.from_pydict({"languages": [model.languages], "weights": [model.weights.tobytes()], "transitions": [model.transitions.tobytes()]}, pa.schema([("languages", pa.list_(pa.string())), ("weights", pa.binary()), ("transitions", pa.binary())]))


def train(documents: DataFrame, rule: F.Column | None = None) -> Model:
    """Model fitted in one task to the bounded sample of documents."""
    found = training_sample(documents, rule).repartition(1).mapInArrow(_fit_rows, "languages array<string>, weights binary, transitions binary").collect()
    if not found or not found[0]["languages"]:
        return fit([])
    k = len(found[0]["languages"])
    return Model(found[0]["languages"], np.frombuffer(found[0]["weights"], np.float32).reshape(-1, k), np.frombuffer(found[0]["transitions"], float).reshape(k, k))


def _posteriors(model: Model, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of a part's words and word offsets of its texts.

    Scores are made a small slice at a time (they need tables over bytes); the chains of all
    texts then run together, as their cost follows the longest one.
    """
    scores, counts = [np.zeros((0, len(model.languages)), np.float32)], [np.zeros(1, np.int64)]
    for piece in slices(part):
        data, offsets = text_bytes(pc.utf8_lower(piece.column("text").cast(pa.string())))
        h, start, end, of = words(data, offsets, LETTERS)
        if not len(h) or not model.languages:
            counts.append(np.zeros(piece.num_rows, np.int64))
            continue
        scores.append(_scores(emissions(model.weights, data, start, end, h)))
        counts.append(np.diff(of))
    e, of = np.concatenate(scores), np.cumsum(np.concatenate(counts))
    if not len(e):
        return e, of
    return posteriors(e, of, np.exp(model.transitions - model.transitions.max()).astype(np.float32)), of


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """documents' columns other than lang_pred and score, then lang_pred string, score double, and
    n_switches long (neighbouring words of different languages)."""
    kept = [f for f in documents.schema.fields if f.name not in ("lang_pred", "score", "n_switches")]
    out = documents.select(*[f.name for f in kept])
    schema = out.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_switches")).schema
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                post, of = _posteriors(model, part)
                n = part.num_rows
                total = np.zeros((n, max(1, len(model.languages))))
                switches = np.zeros(n, np.int64)
                count = np.diff(of)
                if len(post):
                    some = count > 0
                    total[some] = np.add.reduceat(post, of[:-1][some], axis=0)
                    best = post.argmax(1)
                    owner = np.repeat(np.arange(n), count)
                    changed = np.flatnonzero((best[1:] != best[:-1]) & (owner[1:] == owner[:-1]))
                    switches = np.bincount(owner[changed], minlength=n)
                top = total.argmax(1)
                texts = part.column("text")
                named, score = [], []
                for i in range(n):
                    # words may be made of marks beyond ASCII only: a letter is what Unicode calls one
                    clear = count[i] > 0 and any(map(str.isalpha, texts[i].as_py()))
                    named.append(model.languages[top[i]] if clear and model.languages else "und")
                    score.append(float(min(1.0, total[i, top[i]] / count[i])) if clear and model.languages else 0.0)
                extra = [pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(switches, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=schema.names)

    return out.mapInArrow(predict, schema)


def label_runs(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, lang): maximal runs of words of one language, as word offsets."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                post, of = _posteriors(model, part)
                if not len(post):
                    continue
                best, owner = post.argmax(1), np.repeat(np.arange(part.num_rows), np.diff(of))
                head = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1]))))
                tail = np.concatenate((head[1:], [len(best)]))
                ids = part.column("doc_id").take(pa.array(owner[head]))
                langs = pa.array([model.languages[i] for i in best[head]], pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(head - of[owner[head]]), pa.array(tail - of[owner[head]]), langs], names=["doc_id", "start", "end", "lang"])

    return documents.select("doc_id", "text").mapInArrow(label, "doc_id long, start long, end long, lang string")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, ~held_out())
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_switches")
