"""Near-duplicate documents by a signature-coordinate inverted join.

Texts become sets of word shingles and sets become MinHash signatures of K
coordinates.  Every document is posted under each (coordinate, value) pair.  Two
documents are candidates if at least MATCHES of their K postings agree, so (prefix
principle) they meet in one of the K-MATCHES+1 rarest postings of both: only those
lists are merged, and the other coordinates are counted for the pairs that met
(skipped for all the rest).  Candidates are confirmed on full shingle sets.

A pair at similarity 0.8 agrees in fewer than MATCHES coordinates with probability
under 1e-5.  Equal sets are one class: a node that posts once.  Lists over LIGHT members
are not paired: each member is compared with the list's pivot (its most typical node: the
one whose lists are longest), and only members that stay outside the pivot's component are
then compared with the whole list, block against block, without writing out the pairs; a
pair that shares several long lists is compared in the first of them.  The blocks of a list are dealt
to tasks by runs of LEFT_BLOCKS, so a hot list is the work of many tasks.

Defined cases: text that is null or without words has an empty set and links with
nothing; fewer words than the shingle width form one shingle; rows that share a
doc_id are one document, linked if any of their texts is; a null doc_id links with nothing
and has a null component; repeated rows are each returned; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, mix, slices, stored, text_bytes, words
from .components import connected

K = 32
MATCHES = 15
LIGHT = 64
BLOCK = 128
LEFT_BLOCKS = 8
HELD = 4_000_000  # hits that a task holds before it gives them on: 32 MB
SHINGLE_WORDS = 5
SIMILARITY = (4, 5)  # 0.8

_rng = np.random.default_rng(20240601)
MULTIPLY = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(1, 1 << 63, K, dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text, and n+1 offsets."""
    data, offsets = text_bytes(column)
    h, _, _, of = words(data, offsets, SPACED)
    count = np.diff(of)
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(of[:-1], size)
    g = np.zeros(len(at), np.uint64)
    length = np.minimum(count, width)[owner]
    for k in range(width):
        some = slice(None) if k == 0 else np.flatnonzero(length > k)
        g[some] = mix(g[some] * np.uint64(0x9FB21C651E98DF25) + h[at[some] + k] + np.uint64(1))
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(len(count) + 1))


def _sketch(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                g, of = shingle_sets(part.column("text"), width)
                size = np.diff(of)
                full = size > 0
                heads = of[:-1][full]
                signature = np.zeros((len(size), K), np.int64)
                total = np.zeros((len(size), 2), np.uint64)
                if len(g):
                    for c in range(K):
                        low = np.minimum.reduceat((g * MULTIPLY[c] + ADD[c]) >> np.uint64(32), heads)
                        signature[full, c] = low.astype(np.int64) | (c << 32)
                    total[full, 0] = np.add.reduceat(mix(g + np.uint64(1)), heads)
                    total[full, 1] = np.add.reduceat(mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), heads)
                raw = total.tobytes()
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * K), pa.array(signature.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(size, pa.int64()), pa.array([raw[16 * i : 16 * i + 16] for i in range(len(size))], pa.binary()), flat],
                    names=["doc_id", "key", "n_shingles", "digest", "signature"],
                )

    return run


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text, and a key that tells the texts of one doc_id apart."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("text"))


def sketches(documents: DataFrame, width: int) -> DataFrame:
    return keyed(documents).mapInArrow(_sketch(width), "doc_id long, key long, n_shingles long, digest binary, signature array<long>")


def _alike(a: F.Column, b: F.Column) -> F.Column:
    p, q = SIMILARITY
    return F.least(a, b) * q >= F.greatest(a, b) * p


def postings(classes: DataFrame) -> DataFrame:
    """(key, members, node, n, typical) for the postings in each node's prefix.

    members: how many nodes the list has; typical: how many nodes the node's lists have together,
    which is most for a text that others are variants of.
    """
    posts = classes.select("node", "n", F.explode("signature").alias("key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = posts.join(sizes, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("members", "key"))).alias("p"), F.sum("members").alias("typical"))
    # postings that nobody shares are the rarest, and come first in the prefix
    first = F.slice("p", F.lit(1), F.greatest(F.lit(0), F.lit(1 - MATCHES) + F.size("p")))
    return shared.select("node", "n", "typical", F.explode(first).alias("p")).select("p.key", "p.members", "node", "n", "typical")


def _exact(width: int) -> Callable:
    p, q = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                g, of = shingle_sets(pa.concat_arrays([part.column("text_a"), part.column("text_b")]), width)
                n = part.num_rows
                for k in range(n):
                    a, b = g[of[k] : of[k + 1]], g[of[n + k] : of[n + k + 1]]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(q * both >= p * (len(a) + len(b) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose signatures agree in MATCHES coordinates or more."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("signature").alias(f"signature_{side}")), side)
    return pairs.filter(F.size(F.array_intersect("signature_a", "signature_b")) >= MATCHES).select("a", "b").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar."""
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(_exact(width), "a long, b long").distinct()


class _Side:
    def __init__(self, block: pa.StructArray) -> None:
        self.node, self.component = (block.field(f).to_numpy(zero_copy_only=False) for f in ("node", "component"))
        self.posted = block.field("posted").to_numpy(zero_copy_only=False)
        self.signature = block.field("signature").flatten().to_numpy(zero_copy_only=False).reshape(len(self.node), K) if "signature" in [f.name for f in block.type] else None
        self.texts = block.field("text") if "text" in [f.name for f in block.type] else None


def _owned(left: _Side, right: _Side, key: int) -> np.ndarray:
    """Pairs of two blocks of a list that agree in MATCHES coordinates, are of different components,
    and share no long list of an earlier coordinate."""
    agree = np.zeros((len(left.node), len(right.node)), np.int16)
    own = left.component[:, None] != right.component[None]
    for c in range(K):
        same = left.signature[:, c, None] == right.signature[None, :, c]
        agree += same
        if c < key >> 32:
            own &= ~(same & (left.posted >> c & 1).astype(bool)[:, None] & (right.posted >> c & 1).astype(bool)[None])
    return own & (agree >= MATCHES)


def _active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each list that agree with a node of another block and of another component; each
    is given once for the block pairs of a task (or of so many hits)."""
    hits: dict[int, list[np.ndarray]] = {}

    def given() -> pa.RecordBatch:
        nodes = [np.unique(np.concatenate(x)) for x in hits.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(hits), pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], names=["key", "nodes"])

    held = 0
    for batch in batches:
        for i in range(batch.num_rows):
            key = batch.column("key")[i].as_py()
            left, right = _Side(batch.column("left")[i].values), _Side(batch.column("right")[i].values)
            pair = _owned(left, right, key)
            for side, hit in ((left, pair.any(1)), (right, pair.any(0))):
                if hit.any():
                    hits.setdefault(key, []).append(side.node[hit])
                    held += int(hit.sum())
            if held >= HELD:
                yield given()
                hits.clear()
                held = 0
    if hits:
        yield given()


def _block_links(width: int) -> Callable:
    """Links between the members of blocks left and right: a spanning forest of them."""
    p, q = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for i in range(batch.num_rows):
                left, right = _Side(batch.column("left")[i].values), _Side(batch.column("right")[i].values)
                m = len(left.node)
                g, of = shingle_sets(pa.concat_arrays([left.texts, right.texts]), width)
                owner = np.repeat(np.arange(len(of) - 1), np.diff(of))
                names, at = np.unique(g, return_inverse=True)
                shared = np.zeros((2, len(names)), bool)
                shared[(owner >= m).astype(int), at] = True
                column = np.cumsum(shared.all(0)) - 1
                inside = shared.all(0)[at]
                owner, at = owner[inside], column[at[inside]]
                both = np.zeros((m, len(of) - 1 - m), np.float32)
                for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 16384):
                    dense = np.zeros((len(of) - 1, 16384), np.float32)
                    some = (at >= lo) & (at < lo + 16384)
                    dense[owner[some], at[some] - lo] = 1
                    both += dense[:m] @ dense[m:].T
                both = np.rint(both).astype(np.int64)
                size = np.diff(of)
                link = (q * both >= p * (size[:m, None] + size[None, m:] - both)) & (both > 0)
                link &= left.component[:, None] != right.component[None]
                root: dict[int, int] = {}

                def find(x: int, root: dict = root) -> int:
                    while root.setdefault(x, x) != x:
                        root[x] = x = root[root[x]]
                    return x

                for r, c in np.argwhere(link).tolist():
                    u, v = find(int(left.component[r])), find(int(right.component[c]))
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        out_a.append(int(left.node[r]))
                        out_b.append(int(right.node[c]))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def _sides(rows: DataFrame, payload: str) -> DataFrame:
    """(key, left, right): blocks of each list's open members against blocks of all its members."""
    counts = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.col("open").cast("long")).alias("n_open")).filter("n_open > 0")
    rows = rows.join(counts, "key")

    def blocks(of: DataFrame, n: str) -> DataFrame:
        parts = F.ceil(F.col(n) / BLOCK)
        part = F.pmod(F.xxhash64("node"), parts).alias("part")
        runs = F.ceil(F.ceil(F.col("n_open") / BLOCK) / LEFT_BLOCKS).alias("runs")
        return of.select("key", part, runs, F.struct("node", "component", "posted", payload).alias("x")).groupBy("key", "part", "runs").agg(F.collect_list("x").alias("block"))

    left = blocks(rows.filter("open"), "n_open").select("key", F.floor(F.col("part") / LEFT_BLOCKS).alias("run"), F.col("block").alias("left"))
    right = blocks(rows, "members").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), F.col("block").alias("right"))
    return left.join(right, ["key", "run"])


def _residual(member: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Links of open members of long lists with any member of another component.

    Blocks are compared inside tasks: first by signatures, which leaves the members that agree
    with anyone, then these by full sets.
    """
    found = _sides(member, "signature").select("key", "left", "right").mapInArrow(_active, "key long, nodes array<long>")
    active = stored(found.select("key", F.explode("nodes").alias("node")).distinct(), "active")
    rows = stored(member.drop("signature").join(active, ["key", "node"]).join(texts, "node"), "compared")
    return stored(_sides(rows, "text").select("left", "right").mapInArrow(_block_links(width), "a long, b long"), "links")


def _members(heavy: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the long lists with some member outside the pivot's component (open); posted has a bit
    for each coordinate under which the node stands in a long list."""
    of = found.select(F.col("node").alias("pivot"), F.col("component").alias("main"))
    rows = heavy.join(found, "node", "left").join(of, "pivot", "left").withColumn("component", F.coalesce("component", "node"))
    rows = stored(rows.select("key", "node", "component", (F.col("component") != F.coalesce("main", "pivot")).alias("open")), "members")
    undecided = rows.filter("open").select("key").distinct()
    posted = heavy.groupBy("node").agg(F.sum(F.expr("shiftleft(1L, int(shiftright(key, 32)))")).alias("posted"))
    return stored(rows.join(undecided, "key", "left_semi").join(classes.select("node", "signature").join(posted, "node"), "node"), "members")


def near_duplicates(documents: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of documents."""
    sketch = stored(sketches(documents, width), "sketches")
    some = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.min("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = stored(classes.select("*", F.monotonically_increasing_id().alias("node")), "classes")
    lists = stored(postings(classes), "postings")
    light, heavy = lists.filter(F.col("members") <= LIGHT), lists.filter(F.col("members") > LIGHT)
    pivots = heavy.groupBy("key").agg(F.max_by("node", F.struct("typical", -F.col("node"))).alias("pivot"))
    heavy = stored(heavy.join(pivots, "key").select("key", "members", "pivot", "node"), "heavy")
    a, b = (light.select("key", F.col("node").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = a.join(b, "key").filter((F.col("a") < F.col("b")) & _alike(F.col("n_a"), F.col("n_b"))).select("a", "b")
    stars = heavy.filter("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
    near = stored(agreeing(pairs.union(stars).distinct(), classes), "candidates")
    wanted = near.select("a").union(near.select("b")).union(heavy.select("node")).distinct().withColumnRenamed("a", "node")
    sources = classes.join(wanted, "node", "left_semi").select("node", "first.doc_id", "first.key")
    texts = stored(keyed(documents).join(sources, ["doc_id", "key"]).select("node", "text").dropDuplicates(["node"]), "texts")
    # first each node with its smallest candidate; then only pairs that are not connected yet
    first = near.groupBy("b").agg(F.min("a").alias("a"))
    links = stored(confirmed(first, texts, width), "links")
    found = stored(connected(links), "found")
    of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    apart = F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
    rest = near.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").filter(apart).select("a", "b")
    second = stored(confirmed(rest, texts, width), "links")
    if not second.isEmpty():
        links = links.union(second)
        found = connected(links)
    more = _residual(_members(heavy, found, classes), texts, width)
    if not more.isEmpty():
        found = connected(links.union(more))
    # rows that share a doc_id but not a set link their classes
    member = some.join(classes.select("digest", "node"), "digest").select("doc_id", "node")
    several = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last").select("doc_id", "a")
    shared = stored(member.join(several, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b").distinct(), "shared")
    if not shared.isEmpty():
        found = connected(links.union(more).union(shared))
    # a component is named by its smallest document
    whole = classes.join(found, "node", "left").select("digest", "first.doc_id", F.coalesce("component", "node").alias("component"))
    least = whole.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = whole.join(least, "component").select("digest", F.col("least").alias("component_id"))
    return (
        sketch.join(named, "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
