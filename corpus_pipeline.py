"""A training corpus from documents: filter, drop near duplicates, decontaminate, mask, encode.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the one before it
kept, and returns a DataFrame; all but the last return the columns of ``docs``.

Stages tell rows apart by id and text, so that an id may repeat or be null. Null and
empty texts are documents without words: they are no duplicates, are not
contaminated, and pass. Of rows with one id and one text one stays (the second stage
drops the others). Columns besides ``doc_id`` and ``text`` are passed on, whatever
their names; ``n_chars`` follows the text where there is such a column. An empty
table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm import bpe, decontaminate, jaccard, pii, quality
from redactory.llm.storage import Scratch

#: A table of keys of up to this many rows may be broadcast.
BROADCAST_ROWS = 2_000_000


def _key() -> Column:
    """What tells rows apart; ids come before no id."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"))


def _with_key(docs: DataFrame) -> DataFrame:
    """``(key, row)``: names of columns cannot clash inside ``row``."""
    return docs.select(_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _those(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` with or without the ``keys``."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "key", how)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps."""
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near duplicates (five words, 0.8)."""
    rows, scratch = _with_key(docs), Scratch(spark, "stage-jaccard")
    classes = jaccard.classes(docs.select(_key().alias("key"), "text"), words=5, percent=80, id_col="key")
    keys = scratch.keep(classes.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("key") == F.col("component_id")).alias("stays")), "keys")
    kept = _those(rows, keys.where("NOT stays").select("key"), "left_anti")
    repeated = keys.where("stays AND n > 1").select("key")
    if not repeated.isEmpty():
        kept = _those(kept, repeated, "left_anti").unionByName(_those(kept, repeated, "left_semi").dropDuplicates(["key"]))
    return kept.select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark window occurs."""
    found = decontaminate.contamination(docs.select(_key().alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    gone = Scratch(spark, "stage-decontaminate").keep(found.where("contaminated").select("key").distinct(), "gone")
    return _those(_with_key(docs), gone, "left_anti").select("row.*")


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; ``n_chars`` follows the text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)``: ids are little-endian unsigned 32-bit integers."""
    done = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii_masking),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: Models are trained in some stages: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
