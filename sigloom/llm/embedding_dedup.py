"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Rotations learned on a bounded sample of distinct vectors (TRAIN_VECTORS) give balanced
binary codes.  A code is cut into substrings, one a table; a vector is found under its own
substring and under those one bit away.  Pairs are kept in the first table where they
meet, and reranked by cosine on the original vectors in double precision.

The length of a substring follows the logarithm of the largest label's number of vectors,
so that unrelated vectors that meet stay a few a vector at any size; the number of tables
follows from it so that a pair at the bar is missed with probability MISSED (if bits were
independent; tests measure recall).  Vectors with fewer dimensions than a code has bits
get the rest from further rotations.

Every vector is indexed.  Equal vectors of a label form one class that is indexed once.
Buckets of more than LIGHT classes are compared block against block inside tasks, which
return each class's number of links and a spanning forest, not the pairs.

Defined cases: a null label, a null, empty or zero vector, and one with null or
non-finite components link with nothing; vectors of different lengths are not compared;
repeated rows are vectors of their own in n_links; rows that share a vec_id are one node
of the components; a null vec_id has a null component; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .components import connected

COSINE = 0.98
TRAIN_VECTORS = 4096
MISSED = 0.0005
SPARE_BITS = 3  # of a substring, beyond the logarithm of the number of vectors
BITS_MIN, BITS_MAX = 8, 40  # of a substring
TABLES_MAX = 24
FAR = 0.3  # share of differing bits beyond which a pair is not reranked; at cosine 0.98 it is 0.064
LIGHT = 128
BLOCK = 512
LEFT_BLOCKS = 8


def valid_vector(column: str = "embedding") -> F.Column:
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def layout(vectors: int, bar: float = COSINE) -> tuple[int, int]:
    """(substring bits, tables) for so many vectors of one label."""
    bits = min(BITS_MAX, max(BITS_MIN, math.ceil(math.log2(max(2, vectors))) + SPARE_BITS))
    q = math.acos(min(1.0, max(-1.0, bar))) / math.pi
    meet = (1 - q) ** bits + bits * q * (1 - q) ** (bits - 1)
    tables = 1 if meet >= 1 else min(TABLES_MAX, math.ceil(math.log(MISSED) / math.log(1 - meet)))
    return bits, tables


def rotations(x: np.ndarray, bits: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection onto so many bits) of unit vectors by iterative quantisation."""
    mean = x.mean(0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=True)
    rng, out, left = np.random.default_rng(5), [], bits
    while left > 0:  # as many bits as there are axes at a time, each time from another start
        top = axes[: min(left, len(axes))].T if not out else axes.T
        v = (x - mean) @ top
        rotation = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
        for _ in range(rounds if not out else 3):  # alternate: nearest binary codes, then the best rotation onto them
            u, _, w = np.linalg.svd(v.T @ np.where(v @ rotation >= 0, 1.0, -1.0))
            rotation = u @ w
        out.append((top @ rotation)[:, :left])
        left -= out[-1].shape[1]
    return mean, np.concatenate(out, axis=1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Unit vectors of a list column; another length: the first d components, or zeros beyond it."""
    size = pc.list_value_length(column).to_numpy()
    flat, heads = column.flatten().to_numpy(), np.cumsum(size) - size
    out = np.zeros((len(size), d))
    for n in np.unique(size):
        some = np.flatnonzero(size == n)
        v = flat[heads[some][:, None] + np.arange(n)]
        v = v / np.abs(v).max(1, keepdims=True)
        out[some, : min(d, n)] = (v / np.linalg.norm(v, axis=1, keepdims=True))[:, :d]
    return out


def learn(embeddings: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """rotations() of at most TRAIN_VECTORS distinct vectors of the commonest length, chosen by hash.

    One task gets the sample; the driver sees the mean and the projection alone."""
    rows = embeddings.select(F.col("embedding").cast("array<double>").alias("v")).filter(valid_vector("v")).withColumn("h", F.xxhash64("v"))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("m")).orderBy(F.desc("n"), "d").first()
    if length is None:
        return np.zeros(1), np.zeros((1, bits))
    d, span = length["d"], 1 << 62
    bar = min(span, span * 2 * TRAIN_VECTORS // max(1, length["m"]))
    picked = rows.filter((F.size("v") == d) & (F.col("h").bitwiseAND(F.lit(span - 1)) <= bar)).distinct().orderBy("h").limit(TRAIN_VECTORS)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = [_matrix(b.column("v"), d) for b in batches]
        mean, projection = rotations(np.concatenate(x), bits) if x else (np.zeros(d), np.zeros((d, bits)))
        yield pa.RecordBatch.from_pydict({"mean": [mean.tobytes()], "projection": [np.ascontiguousarray(projection).tobytes()]}, pa.schema([("mean", pa.binary()), ("projection", pa.binary())]))

    model = picked.select("v").repartition(1).mapInArrow(fit, "mean binary, projection binary").first()
    return np.frombuffer(model["mean"]), np.frombuffer(model["projection"]).reshape(d, bits)


def encode(embeddings: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int) -> DataFrame:
    """(vec_id, label, v, cls, code) of the valid, labelled vectors.

    v is scaled by a power of two (cosines do not change); cls names label and vector; code is a
    substring of so many bits for each table."""
    sent = embeddings.sparkSession.sparkContext.broadcast(model)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("label").isNotNull() & valid_vector("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projection = sent.value
        powers = np.int64(1) << np.arange(bits, dtype=np.int64)
        tables = projection.shape[1] // bits
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                on = (_matrix(batch.column("v"), len(mean)) - mean) @ projection >= 0
                code = (on.reshape(-1, tables, bits) * powers).sum(2)
                names, scaled = [], []
                for label, v in zip(batch.column("label").to_pylist(), batch.column("v"), strict=True):
                    x = v.values.to_numpy()
                    scaled.append(np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])))
                    names.append(hashlib.blake2b(label.encode() + b"\0" + x.tobytes(), digest_size=16).digest())
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * tables, pa.int32()), pa.array(code.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(scaled, pa.list_(pa.float64())), pa.array(names, pa.binary()), codes], names=["vec_id", "label", "v", "cls", "code"])

    return rows.mapInArrow(run, "vec_id long, label string, v array<double>, cls binary, code array<long>")


BUCKET = ("label", "d", "t", "key")


def _posts(classes: DataFrame, bits: int, near: bool, *columns: str) -> DataFrame:
    """Classes under their own substrings, or under these and all that are one bit away."""
    posts = classes.select("label", "d", *columns, F.posexplode("code").alias("t", "key"))
    if not near:
        return posts
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << j).cast("long") for j in range(bits)])
    return posts.withColumn("flip", F.explode(flips)).withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).drop("flip")


def candidates(classes: DataFrame, heavy: DataFrame, bits: int, tables: int) -> DataFrame:
    """(a, b): classes of one label and length whose codes meet in a table, a < b, each pair once;
    without the buckets of heavy."""
    own = _posts(classes, bits, False, F.col("id").alias("a"), F.col("code").alias("code_a")).join(heavy, list(BUCKET), "left_anti")
    other = _posts(classes, bits, True, F.col("id").alias("b"), F.col("code").alias("code_b"))
    differ = F.transform(F.zip_with("code_a", "code_b", lambda x, y: x.bitwiseXOR(y)), F.bit_count)
    pairs = own.join(other, list(BUCKET)).filter("a < b").select("a", "b", "t", differ.alias("differ"))
    total = F.aggregate("differ", F.lit(0), lambda s, x: s + x)
    return pairs.filter((total <= int(FAR * bits * tables)) & ~F.exists(F.slice("differ", F.lit(1), F.col("t")), lambda x: x <= 1)).select("a", "b")


def linked(pairs: DataFrame, classes: DataFrame, bar: float = COSINE) -> DataFrame:
    """Pairs whose cosine is at least bar."""
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("id").alias(x), F.col("v").alias(f"v_{x}"), F.col("norm").alias(f"norm_{x}")), x)
    dot = F.aggregate(F.zip_with("v_a", "v_b", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return pairs.filter(dot / (F.col("norm_a") * F.col("norm_b")) >= bar).select("a", "b")


def _block_links(bar: float, far: int) -> Callable:
    """(a, b, n) of each two blocks: for each class with links its number of linked vectors (b is null),
    and a spanning forest of the links (n is null)."""

    def side(block: pa.StructArray) -> tuple[np.ndarray, ...]:
        ids, copies = (block.field(f).to_numpy(zero_copy_only=False) for f in ("id", "copies"))
        n = len(ids)
        v = block.field("v").flatten().to_numpy().reshape(n, -1)
        return ids, copies, v / np.linalg.norm(v, axis=1, keepdims=True), block.field("code").flatten().to_numpy().reshape(n, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": [], "n": []}
            for i in range(batch.num_rows):
                t = batch.column("t")[i].as_py()
                a, copies_a, u, code_a = side(batch.column("left")[i].values)
                b, copies_b, w, code_b = side(batch.column("right")[i].values)
                link = (u @ w.T >= bar) & (a[:, None] < b[None])
                row, col = np.nonzero(link)
                differ = np.bitwise_count(code_a[row] ^ code_b[col])
                keep = (differ.sum(1) <= far) & (differ[:, :t] > 1).all(1)
                row, col = row[keep], col[keep]
                for ids, weight in ((a, np.bincount(row, copies_b[col], len(a))), (b, np.bincount(col, copies_a[row], len(b)))):
                    some = np.flatnonzero(weight)
                    out["a"] += ids[some].tolist()
                    out["b"] += [None] * len(some)
                    out["n"] += weight[some].astype(np.int64).tolist()
                # each class with the smallest of the other block, and these with each other
                label = np.concatenate((np.arange(len(a)), len(a) + np.arange(len(b))))
                names = np.concatenate((a, b))
                while len(row):
                    low = np.minimum(label[row], label[len(a) + col])
                    high = np.maximum(label[row], label[len(a) + col])
                    apart = low < high
                    row, col, low, high = row[apart], col[apart], low[apart], high[apart]
                    if not len(row):
                        break
                    # one link for each higher label, which then becomes the lower one
                    high, first = np.unique(high, return_index=True)
                    out["a"] += a[row[first]].tolist()
                    out["b"] += b[col[first]].tolist()
                    out["n"] += [None] * len(first)
                    to = np.arange(len(label))
                    to[high] = low[first]
                    while (again := to[to]).tolist() != to.tolist():
                        to = again
                    label = to[label]
            yield pa.RecordBatch.from_pydict(out, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))

    return run


def heavy_links(classes: DataFrame, heavy: DataFrame, bits: int, tables: int, bar: float) -> DataFrame:
    """(a, b, n) of the buckets of heavy, see _block_links."""

    def blocks(near: bool) -> DataFrame:
        rows = _posts(classes, bits, near, "id", "v", "code", "copies").join(heavy, list(BUCKET))
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / BLOCK)).alias("part")
        rows = rows.select(*BUCKET, "runs", part, F.struct("id", "v", "code", "copies").alias("x"))
        # near a bucket there may be many more than in it: these are cut into blocks by a second hash
        cut = F.pmod(F.xxhash64("x.id", F.lit(7)), F.lit(16 if near else 1)).alias("cut")
        return rows.groupBy(*BUCKET, "runs", "part", cut).agg(F.collect_list("x").alias("block"))

    left = blocks(False).select(*BUCKET, F.floor(F.col("part") / LEFT_BLOCKS).alias("run"), F.col("block").alias("left"))
    right = blocks(True).select(*BUCKET, F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), F.col("block").alias("right"))
    return left.join(right, [*BUCKET, "run"]).select("t", "left", "right").mapInArrow(_block_links(bar, int(FAR * bits * tables)), "a long, b long, n long")


def near_duplicates(embeddings: DataFrame, bar: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of embeddings."""
    most = embeddings.filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = layout(most, bar)
    coded = stored(encode(embeddings, learn(embeddings, bits * tables), bits), "codes")
    classes = coded.groupBy("cls").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.first("code").alias("code"), F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    classes = stored(classes.select("*", norm.alias("norm"), F.size("v").alias("d"), F.monotonically_increasing_id().alias("id")), "classes")
    members = _posts(classes, bits, False).groupBy(*BUCKET).agg(F.count("*").alias("members")).filter(F.col("members") > LIGHT)
    runs = F.floor((F.ceil(F.col("members") / BLOCK) - 1) / LEFT_BLOCKS) + 1
    heavy = stored(members.select(*BUCKET, "members", runs.alias("runs")), "buckets")
    links = stored(linked(candidates(classes, heavy.select(*BUCKET), bits, tables), classes, bar), "links")
    size = classes.select(F.col("id").alias("b"), "copies")
    degree = links.select("a", "b").union(links.select("b", "a")).join(size, "b").groupBy("a").agg(F.sum("copies").alias("n"))
    if not heavy.isEmpty():
        more = stored(heavy_links(classes, heavy, bits, tables, bar), "links")
        degree = degree.union(more.filter("b IS NULL").select("a", "n"))
        links = links.union(more.filter("b IS NOT NULL").select("a", "b"))
    degree = degree.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    node = classes.select("id", "node")
    edges = links.join(node.select(F.col("id").alias("a"), F.col("node").alias("x")), "a").join(node.select(F.col("id").alias("b"), F.col("node").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = coded.select("cls", "vec_id").join(classes.select("cls", "node"), "cls").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    found = connected(edges.union(same).filter("a IS NOT NULL AND b IS NOT NULL"))
    info = classes.join(degree, "id", "left").select("cls", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    valid = coded.select("cls", "vec_id").join(info, "cls").select("vec_id", "n_links")
    rest = embeddings.filter(F.col("label").isNull() | ~valid_vector()).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"))
    return (
        valid.unionByName(rest)
        .join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN c ON c.a = e.vec_id
"""
