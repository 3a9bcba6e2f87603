"""Corpus pipeline: language ID, near-dedup, suffix-array dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.  run() writes every stage's rows to the shared folder and reads
them again, so a lost executor costs one stage at most.

What the stages do to a document:
1. language ID sets lang to the predicted language; documents without any letter (`und`)
   go.  The model learns from the rows that carry a lang;
2. of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest
   doc_id stays; texts without words stay.  Repeated rows of that doc_id become one;
3. bytes covered by a 100-byte string that also starts earlier are cut, widened to whole
   characters; of equal texts the first stays, and a document of which nothing but white
   space is left goes;
4. words inside a run of ten benchmark words are cut with what separates them; a document
   of which no word is left goes;
5. the rest gets its slot in the mix of sources.

n_chars follows the text wherever the text changes.  SQL cannot express the learned first
stage, so ORACLE_SQL is None and the stages are tested against brute force.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import decontaminate, language_id, minhash_dedup, mixing, suffix_dedup
from sigloom.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language, and set it."""
    model = language_id.train(docs)
    found = language_id.identify(_documents(docs), model)
    return _documents(found.filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    groups = minhash_dedup.near_duplicates(docs)
    gone = groups.filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return _documents(docs).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def suffix_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings of 100 bytes that occur earlier."""
    columns = ("doc_id", "digest", F.col("kept").cast("string").alias("text"))
    spans = suffix_dedup.repeated_spans(docs, lambda spans: spans.select(*columns), whole_characters=True)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(suffix_dedup.LAST))
    rest = docs.select(key.alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), "lang", "source")
    out = spans.join(rest.dropDuplicates(["doc_id", "digest"]), ["doc_id", "digest"]).filter(F.col("text").rlike(r"\S"))
    return out.select(F.when(F.col("doc_id") != suffix_dedup.LAST, F.col("doc_id")).alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def without_spans(text: str, spans: list[dict]) -> str:
    """Text without the words of the spans (word offsets) and the separators after them."""
    words = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : words[s["start"]][0]])
        at = words[s["end"]][0] if s["end"] < len(words) else len(text)
    return "".join(out) + text[at:]


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [without_spans(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("lang"), batch.column("source"), pa.array([len(t or "") for t in texts], pa.int64())], names=list(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the documents that hold them."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(_documents(docs), benchmark).filter(F.size("spans") > 0)
    hit = stored(found.groupBy("doc_id", "digest").agg(F.first("spans").alias("spans")), "contaminated")
    # an id may have several texts, and its digest tells which are cut
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.digest") == F.col("h.digest"))
    both = _documents(docs).withColumn("digest", digest).alias("d").join(hit.alias("h"), same, "left")
    dirty = both.filter("h.digest IS NOT NULL").select("d.doc_id", "text", "lang", "source", "n_chars", "spans")
    clean = both.filter("h.digest IS NULL").select("d.doc_id", "text", "lang", "source", "n_chars")
    cut = dirty.mapInArrow(_cut_words, docs.select(*COLUMNS).schema)
    return clean.unionByName(cut.filter(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slots in the mix."""
    return mixing.mix(_documents(docs))


STAGES = [("language", language), ("near_dedup", near_dedup), ("suffix_dedup", suffix_cut), ("decontamination", decontamination), ("mixing", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
