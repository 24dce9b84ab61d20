"""Byte-level BPE: overlapping chunk encoding, and decoding.

Method. A text longer than ``chunk_chars`` is cut into overlapping chunks, one
row each, which are pre-tokenised in parallel. Matching runs from left to right
without looking back, so two neighbouring chunks that share one boundary in
their overlap agree on all that follows: there they are stitched. The pieces
between stitches are encoded in parallel and their ids are put in order. Shorter
texts are one piece. A text with a neighbouring pair that shares no boundary
(one word longer than the overlap, say) is encoded as a single piece.
Decoding concatenates the bytes of the ids.

Defined results: a null text counts as empty; an empty text has no ids; repeated
rows each get their own row; columns other than the id and the text are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import small_batches

#: Characters that a pre-token near the end of a chunk may still gain from what follows.
EDGE = 3

_loaded: dict = {}


def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once in each worker."""
    if (rank_file, pattern) not in _loaded:
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        _loaded[rank_file, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[rank_file, pattern]


def ids_of(enc, text: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes() if text else b""


def boundaries(text: str, pattern: str, start: int, step: int, overlap: int) -> tuple[list[int], list[int]]:
    """Starts of pre-tokens in a chunk's first ``overlap`` characters and in its last, absolute."""
    import regex

    head, tail, size = [], [], len(text)
    for m in regex.compile(pattern).finditer(text):
        at = m.start()
        if at < overlap:
            head.append(start + at)
        if step <= at <= size - EDGE:
            tail.append(start + at)
    return head, tail


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32768, overlap_chars: int = 2048) -> DataFrame:
    """``(id_col, n_tokens long, ids binary)`` for each row of ``df``; ids are unsigned 32-bit, little-endian."""
    if not 0 < 2 * overlap_chars < chunk_chars:
        raise ValueError("the overlap must be less than half a chunk")
    small_batches(df.sparkSession)

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            ids = [ids_of(enc, t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.binary())], [*b.schema.names[:-1], "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(encode_rows, f"id {kind}, ids binary")

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.to_pydict()
            found = [boundaries(t, pattern, s, chunk_chars, overlap_chars) for t, s in zip(x["chunk"], x["start"], strict=True)]
            cols = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "head", "tail"])

    # Copies of a long text are encoded once; sha2 stands for the text in the joins.
    long_rows = rows.where(F.length("text") > chunk_chars).withColumn("key", F.sha2("text", 256))
    chunks = (
        long_rows.groupBy("key").agg(F.first("text").alias("text"))
        .select("key", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk_chars))).alias("start"))
        .select("key", "start", F.substring("text", F.col("start") + 1, F.lit(chunk_chars + overlap_chars)).alias("chunk"))
        .repartition("key", "start")
        .mapInArrow(pre_tokenise, "key string, start int, chunk string, head array<int>, tail array<int>")
    )
    order = Window.partitionBy("key").orderBy("start")
    joint = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    whole = Window.partitionBy("key")
    cuts = (
        chunks.withColumn("end", F.when(F.lead("start").over(order).isNull(), F.lit(2**31 - 1)).otherwise(joint))
        .withColumn("begin", F.when(F.col("start") == 0, 0).otherwise(F.lag("end").over(order)))
        .withColumn("apart", F.max(F.col("end").isNull()).over(whole))
        .withColumn("next", F.coalesce(F.lead("start").over(order), F.lit(2**31 - 1)))
    )
    begin, end = F.when(F.col("apart"), F.col("start")).otherwise(F.col("begin")), F.when(F.col("apart"), F.col("next")).otherwise(F.col("end"))
    pieces = cuts.withColumns({"b": begin, "e": end}).select(
        "key",
        F.when(F.col("apart"), 0).otherwise(F.col("start")).alias("piece"),
        F.struct("start", F.expr("substring(chunk, b - start + 1, e - b)").alias("part")).alias("part"),
    )
    encoded = (
        pieces.groupBy("key", "piece").agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select("key", "piece", F.array_join(F.col("parts.part"), "").alias("text"))
        .mapInArrow(encode_rows, "key string, piece int, ids binary")
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("pieces"))
        .select("key", F.aggregate("pieces.ids", F.lit(b""), lambda done, more: F.concat(done, more)).alias("ids"))
    )
    long = long_rows.select("id", "key").join(encoded, "key").select("id", "ids")
    out = short.unionByName(long)
    return out.select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, bytes binary)``: the bytes of each row's ids, one after the other. Null ids count as none."""

    def decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            out = [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) if x else b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(decode_rows, f"id {kind}, bytes binary").select(F.col("id").alias(id_col), "bytes")


def encode_and_decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id_col, n_tokens, ids, bytes)``: :func:`encode`, then the bytes that :func:`decode` makes of the ids."""
    done = encode(df, rank_file, pattern, id_col, text_col, **options)
    kind = df.schema[id_col].dataType.simpleString()

    def decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            out = [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) if x else b"" for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], ["id", "n_tokens", "ids", "bytes"])

    return done.withColumnRenamed(id_col, "id").mapInArrow(decode_rows, f"id {kind}, n_tokens long, ids binary, bytes binary").withColumnRenamed("id", id_col)
