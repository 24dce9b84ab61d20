"""Repeated passages by a sparse suffix array.

Method. Of a document's suffixes only those at content-selected positions are kept:
where the hash of ``gram`` words is the least of ``passage - gram + 1`` in a row. Any
two copies of a passage of ``passage`` words have a kept suffix at the same place.
Suffixes whose first ``gram`` words stand in one document alone are left out. The
others are sorted twice, by what follows and then comes before, and the other way
round; neighbours are compared, and their matches extended left and right. So the
longest match of each suffix to either side is known. Where no neighbour has both,
but a third document may have enough of each, each division of a passage between the
two sides that is still open is looked up by the words themselves, so that all words
of repeated passages are found. A match of ``passage`` words or more covers its
stretch of both documents; overlapping stretches are one passage.

Suffixes with the same words all around are sorted as one, with the least and the
largest document that has them: a passage in a third of all documents is a few
rows in the sort. Ranges of the sorted suffixes are the tasks; the first and last
suffixes of each task are compared on the driver (those of two documents a side).

Words are ``[^ \\t\\n\\v\\f\\r]+`` as written; white space between them does not count.
Only repeats across documents count, not those inside one. Defined results: null
and empty texts, and texts of fewer words than a passage, have no repeats; rows of
one id count as one document; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .storage import Scratch, small_batches

#: Rows of a table of ids that may be broadcast.
BROADCAST_ROWS = 2_000_000


def selected(h: np.ndarray, gram: int, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the least gram hash of every window, and those hashes."""
    if len(h) < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = shingles.grams(h, gram, seed=1)
    window = passage - gram + 1
    at = np.unique(np.lib.stride_tricks.sliding_window_view(g, window).argmin(1) + np.arange(len(g) - window + 1))
    return at, g[at]


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text"))


def suffixes(df: DataFrame, gram: int, passage: int, id_col: str, text_col: str) -> DataFrame:
    """``(id long, at int, gram long)``: the kept suffixes, by word position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, h, first = shingles.joined(b.column(1).to_pylist())
            found = [selected(h[a:z], gram, passage) for a, z in zip(first[:-1], first[1:], strict=True)]
            count = [len(at) for at, _ in found]
            if sum(count):
                ids = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, count)), pa.array(np.concatenate([at for at, _ in found]).astype(np.int32)), pa.array(np.concatenate([g for _, g in found]).view(np.int64))], ["id", "at", "gram"])

    return _texts(df, id_col, text_col).where("id IS NOT NULL").mapInArrow(run, "id long, at int, gram long")


def contexts(rows: DataFrame, gram: int, passage: int) -> DataFrame:
    """``(id, at, gram, right binary, left binary)``: four bytes a word, nearest words first; ``rows`` has ``id, text, at array<int>``."""
    reach = passage - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, h, first = shingles.joined(b.column(1).to_pylist())
            short, grams = (h >> np.uint64(32)).astype(">u4"), None
            out = {"id": [], "at": [], "gram": [], "right": [], "left": []}
            for k, (key, places) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                own, words = short[first[k] : first[k + 1]], h[first[k] : first[k + 1]]
                grams = shingles.grams(words, gram, seed=1).view(np.int64)
                for p in places:
                    if p < len(grams):  # rows of one id with several texts
                        out["id"].append(key)
                        out["at"].append(p)
                        out["gram"].append(int(grams[p]))
                        out["right"].append(own[p + gram : p + gram + reach].tobytes())
                        out["left"].append(own[max(0, p - reach) : p][::-1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["at"], pa.int32()), pa.array(out["gram"], pa.int64()), pa.array(out["right"], pa.binary()), pa.array(out["left"], pa.binary())], list(out))

    return rows.mapInArrow(run, "id long, at int, gram long, right binary, left binary")


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of two arrays; 0 is padding and equal to nothing."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), a.shape[1], (~same).argmax(1)) if a.shape[1] else np.zeros(len(a), np.int64)


def _unpacked(values: pd.Series, reach: int) -> np.ndarray:
    out = np.zeros((len(values), reach), np.uint32)
    for i, v in enumerate(values):
        out[i, : len(v) // 4] = np.maximum(np.frombuffer(v, ">u4"), 1)
    return out


def compare(pdf: pd.DataFrame, gram: int, passage: int) -> pd.DataFrame:
    """For sorted suffixes: how far each matches the suffix of another document before it and after it.

    Returns ``of, left_reach, right_reach, other`` with up to four rows a suffix;
    ``other`` is null where the match is too short for a passage.
    """
    reach = passage - gram
    right, left = _unpacked(pdf["right"], reach), _unpacked(pdf["left"], reach)
    g, low, high, n = (pdf[c].to_numpy() for c in ("gram", "low", "high", "of"))
    size = len(pdf)
    found = []
    both = np.flatnonzero(low != high)  # the same words all around in two documents
    for other in (low[both], high[both]):
        found.append((both, (left[both] != 0).sum(1), (right[both] != 0).sum(1), other))
    # Suffixes of one document in a row are skipped: they do not match each other.
    new = _new(pdf)
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    for j in (starts[run] - 1, np.append(starts[1:], size)[run]):
        i = np.flatnonzero((j >= 0) & (j < size))
        i, j = i[g[i] == g[j[i]]], j[i[g[i] == g[j[i]]]]
        found.append((i, _common(left[i], left[j]), _common(right[i], right[j]), np.where(low[j] != low[i], low[j], high[j])))
    i, l, r, other = (np.concatenate(x) for x in zip(*found, strict=True))  # noqa: E741
    out = pd.DataFrame({"of": n[i], "left_reach": l.astype(np.int32), "right_reach": r.astype(np.int32), "other": pd.array(other, "Int64")})
    out.loc[l + r + gram < passage, "other"] = pd.NA
    return out


def _new(pdf: pd.DataFrame) -> np.ndarray:
    """Where a suffix is of another document than the one before it; the same words in two documents are always."""
    low, high = pdf["low"].to_numpy(), pdf["high"].to_numpy()
    return np.concatenate([[True], (low[1:] != low[:-1]) | (low[1:] != high[1:]) | (low[:-1] != high[:-1])]) if len(pdf) else np.zeros(0, bool)


def neighbours(one: DataFrame, gram: int, passage: int, scratch: Scratch, turned: bool) -> DataFrame:
    """``(of, left_reach, right_reach, other)`` of :func:`compare` over all suffixes in right order, or ``turned`` in left order."""
    spark = one.sparkSession
    context = ["of", "gram", "right", "left", "low", "high"]
    if turned:
        one = one.select("of", "gram", F.col("left").alias("right"), F.col("right").alias("left"), "low", "high")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = one.repartitionByRange(parts, "gram", "right", "left").sortWithinPartitions("gram", "right", "left", "of")
    schema = "of long, left_reach int, right_reach int, other long"
    table = f"{schema}, part int, row int, gram long, right binary, left binary, low long, high long"
    columns = [c.split()[0] for c in table.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's suffixes in order; the last two documents' are carried over to the next batch. Those at the edges are rows of their own."""
        carried, head = None, None
        for b in batches:
            if not len(b):
                continue
            b = b if carried is None else pd.concat([carried, b], ignore_index=True)
            yield compare(b, gram, passage).assign(part=-1).reindex(columns=columns)
            starts = np.flatnonzero(_new(b))
            if head is None and len(starts) > 1:
                head = b.iloc[: starts[1] + 1]
            carried = b.iloc[starts[-1] - 1 if len(starts) > 1 else 0 :]
        if carried is not None:
            edge = carried if head is None else pd.concat([head, carried])
            yield edge.assign(part=TaskContext.get().partitionId(), row=np.arange(len(edge))).reindex(columns=columns)

    done = scratch.keep(in_order.select(*context).mapInPandas(run, table), "left-order" if turned else "right-order")
    # Pairs of one task's edges are compared again, which does no harm.
    edges = done.where("part >= 0").orderBy("part", "row").select(*context).toPandas()
    out = done.where("part < 0").select("of", "left_reach", "right_reach", "other")
    if len(edges):
        more = compare(edges, gram, passage)
        out = out.unionByName(spark.createDataFrame([(int(o), int(a), int(z), None if pd.isna(x) else int(x)) for o, a, z, x in more.itertuples(index=False)], schema))
    return out.select("of", F.col("right_reach").alias("left_reach"), F.col("left_reach").alias("right_reach"), "other") if turned else out


def divided(one: DataFrame, near: DataFrame, gram: int, passage: int, scratch: Scratch) -> DataFrame:
    """Matches ``(of, left_reach, right_reach, other)`` of exactly a passage that no neighbour in ``near`` has.

    A suffix that matches some document by ``most_left`` words and some by
    ``most_right`` can have a passage of ``a`` words to the left and the rest to the
    right, if both are in reach; it has, if another document has these words.
    """
    reach = passage - gram
    enough = F.col("other").isNotNull()
    known = near.groupBy("of").agg(
        F.max("left_reach").alias("most_left"), F.max("right_reach").alias("most_right"), F.coalesce(F.max(F.when(enough, F.col("left_reach"))), F.lit(-1)).alias("has_left"), F.coalesce(F.max(F.when(enough, F.col("right_reach"))), F.lit(-1)).alias("has_right")
    )
    within = one.join(known.where(F.col("most_left") + F.col("most_right") >= reach), "of")
    within = scratch.keep(within.withColumn("open", (F.col("low") == F.col("high")) & ((F.col("has_left") < F.col("most_left")) | (F.col("has_right") < F.col("most_right")))), "within")
    within = within.join(scratch.keep(within.where("open").select("gram").distinct(), "open"), "gram", "left_semi")
    words = F.xxhash64("gram", "a", F.expr("substring(left, 1, 4 * a)"), F.expr(f"substring(right, 1, 4 * ({reach} - a))"))
    every = within.withColumn("a", F.explode(F.sequence(F.lit(reach) - F.col("most_right"), F.col("most_left")))).withColumn("words", words)
    asked = every.where("open").where((F.col("a") > F.col("has_left")) | (F.lit(reach) - F.col("a") > F.col("has_right"))).select("of", "a", "words", F.col("low").alias("own"))
    held = every.groupBy("words").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    other = F.when(F.col("low") != F.col("own"), F.col("low")).otherwise(F.col("high"))
    return asked.join(held, "words").select("of", F.col("a").alias("left_reach"), (F.lit(reach) - F.col("a")).alias("right_reach"), other.alias("other"))


def repeated(df: DataFrame, passage: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, start_word int, end_word int, n_words int, other_id)``: the repeated passages of each document.

    Word positions count from 0, ends are exclusive; ``other_id`` is another
    document that has at least ``passage`` words of the passage.
    """
    spark = df.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "repeats")
    kept = scratch.keep(suffixes(df, gram, passage, id_col, text_col), "suffixes")
    # A table of its own: joined from an aggregate, a gram of very many suffixes would be left to one task.
    shared = scratch.keep(kept.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("gram"), "shared")
    places = scratch.keep(kept.join(shared, "gram", "left_semi").groupBy("id").agg(F.collect_set("at").alias("at")), "places")
    scratch.drop("suffixes")
    scratch.drop("shared")

    rows = _texts(df, id_col, text_col)
    if places.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(places.select("id")), "id", "left_semi")
    around = rows.join(places, "id").select("id", "text", "at")
    around = contexts(around, gram, passage).withColumn("of", F.xxhash64("gram", "right", "left"))
    around = scratch.keep(around, "contexts")
    one = scratch.keep(around.groupBy("of", "gram", "right", "left").agg(F.min("id").alias("low"), F.max("id").alias("high")), "one")
    near = neighbours(one, gram, passage, scratch, False).unionByName(neighbours(one, gram, passage, scratch, True))
    matches = near.where("other IS NOT NULL").unionByName(divided(one, near, gram, passage, scratch))

    found = around.select("id", "at", "of").join(matches.distinct(), "of").where("id <> other OR other IS NULL")
    spans = found.select("id", (F.col("at") - F.col("left_reach")).alias("start"), (F.col("at") + gram + F.col("right_reach")).alias("end"), "other")
    order = Window.partitionBy("id").orderBy("start", "end")
    so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", (so_far.isNull() | (F.col("start") > so_far)).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy("id", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other_id"))
    return out.select(F.col("id").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_id")


def remove(df: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the passages of :func:`repeated` that a smaller id also has; the first document keeps its copy."""
    cuts = passages.where(F.col("other_id") < F.col(id_col)).groupBy(id_col).agg(F.collect_list(F.struct("start_word", "end_word")).alias("__cuts"))

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, all_cuts in batches:
            out = []
            for text, of_text in zip(texts.to_pylist(), all_cuts.to_pylist(), strict=True):
                if text is None or not of_text:
                    out.append(text)
                    continue
                data = text.encode()
                start, end, _ = shingles.hash_words(data)
                parts, at = [], 0
                for c in sorted(of_text, key=lambda c: c["start_word"]):
                    if c["start_word"] < len(start):
                        parts.append(data[at : max(at, start[c["start_word"]])])
                        at = max(at, int(end[min(c["end_word"], len(end)) - 1]))
                out.append(b"".join([*parts, data[at:]]).decode(errors="replace"))
            yield pa.array(out, pa.string())

    return df.join(cuts, id_col, "left").withColumn(text_col, cut(F.col(text_col), F.col("__cuts"))).select(*df.columns)
