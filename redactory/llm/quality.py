"""Quality classifier by importance resampling.

Method. Two generative models of hashed n-grams are counted: one of the raw
corpus (all documents), one of the target (documents labelled good). N-grams are
byte trigrams, words and word pairs; a word after itself is an n-gram of its own.
A document's importance weight is the ratio of its probabilities under the two models,
the product of its n-grams' ratios. Documents are sampled without replacement in
proportion to their weights by Gumbel top-k: ``key = log weight / temperature + Gumbel
noise`` (fixed by id, text and seed), and the ``k`` largest keys are kept. At the default
temperature of 1 the weights are those of the models; above it they are flatter.

``k`` is the number of documents whose log weight reaches the threshold that parts
labelled good from labelled bad best. Documents whose weights are near it, which are
mostly short ones, are kept or not by chance; the weights of long ones leave little to
it. The target model and the threshold come from at most about ``max_labels`` labelled
rows (all of them if there are fewer), the raw model from all documents, and every
document is scored and ranked. Log ratios are whole numbers of ``1 / SCALE``, so that a sum
does not depend on how rows are dealt out. :func:`resample` scores texts a second time,
where a join would have to shuffle them.

Defined results: null and empty texts have no n-grams and weight 1; equal keys at the
border are all kept; repeated rows have equal keys; without labels of both kinds
the threshold is ``-inf`` and everything is kept; an empty table gives an empty
table; other columns are ignored or passed on unchanged, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .storage import Scratch, small_batches

#: Bits of the buckets of byte trigrams, of words and of word pairs.
GRAM_BITS, WORD_BITS = 16, 14
WORDS = 1 << GRAM_BITS
PAIRS = WORDS + (1 << WORD_BITS)
#: A word after itself.
SAME = PAIRS + (1 << WORD_BITS)
BUCKETS = SAME + 1
#: Stands for grams across texts; counts for none.
NONE = BUCKETS
#: Log ratios are counted in parts of this size.
SCALE = 1 << 24
#: Bytes of text looked at together.
BLOCK = 1 << 19


def blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of byte grams and of word grams, and where each text's begin (one more than texts)."""
    a = np.frombuffer(b"\n".join(texts) + b"\n\n", np.uint8).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    code = a[:-2] | (a[1:-1] << 8) | (a[2:] << 16)
    gram = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)
    size = np.diff(at) - 1
    for back in (0, 1, 2):
        p = at[1:] - 1 - back
        gram[p[(size >= back) & (p < len(gram))]] = NONE
    _, _, h, first = shingles.joined(texts)
    word = (WORDS + (h >> np.uint64(64 - WORD_BITS))).astype(np.int32)
    pair = np.full(len(h), NONE, np.int32)
    if len(h) > 1:
        pair[1:] = np.where(h[1:] == h[:-1], SAME, (PAIRS + (shingles.mix(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(64 - WORD_BITS))).astype(np.int32))
        pair[first[:-1][first[:-1] < len(h)]] = NONE
    return gram, np.stack([word, pair], 1).ravel(), at, 2 * first


@dataclass
class Model:
    log_ratio: np.ndarray  # whole numbers of 1 / SCALE

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Total log ratio and number of n-grams of each text."""
        total, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in blocks(texts):
            gram, word, at, first = buckets(part)
            sums, sizes = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for codes, edge in ((gram, np.minimum(at, len(gram))), (word, first)):
                for out, values in ((sums, self.log_ratio[codes]), (sizes, codes != NONE)):
                    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
                    out += run[edge[1:]] - run[edge[:-1]]
            total.append(sums)
            count.append(sizes)
        return np.concatenate(total) / SCALE, np.concatenate(count)

    def column(self, text: Column) -> Column:
        """``struct<log_weight double, n_grams long>`` of a text column."""
        model = self

        @F.arrow_udf("struct<log_weight: double, n_grams: long>")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                w, n = model.score(b.to_pylist())
                yield pa.StructArray.from_arrays([pa.array(w), pa.array(n)], ["log_weight", "n_grams"])

        return scored(F.encode(F.coalesce(text, F.lit("")), "utf-8"))


def sample_labels(labels: DataFrame, label_col: str, max_labels: int, id_col: str) -> DataFrame:
    """``(id_col, label)`` of about ``max_labels`` ids with a label, picked by a hash of the id; all, if there are fewer."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    n = known.count()
    return known if n <= max_labels else known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(max_labels / n * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 50_000) -> Model:
    """Count both models. The counts that reach the driver are one row a bucket, however many documents there are."""
    small_batches(docs.sparkSession)
    good = sample_labels(labels, label_col, max_labels, id_col).where("label = 1").select(F.col(id_col).alias("id"), F.lit(True).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            texts, flag = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part in blocks([t for t, g in zip(texts, flag, strict=True) if not g]):
                for codes in buckets(part)[:2]:
                    raw += np.bincount(codes, minlength=BUCKETS + 1)
            for part in blocks([t for t, g in zip(texts, flag, strict=True) if g]):
                for codes in buckets(part)[:2]:
                    target += np.bincount(codes, minlength=BUCKETS + 1)
        raw += target
        there = np.flatnonzero(raw[:NONE])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(there, pa.int32()), "raw": pa.array(raw[there]), "target": pa.array(target[there])})

    texts = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text"))
    rows = texts.join(F.broadcast(good), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    log_p = {}
    for name in ("raw", "target"):
        n = np.zeros(BUCKETS)
        n[counts["bucket"].to_numpy(np.int64)] = counts[name].to_numpy(float)
        log_p[name] = np.log((n + 1) / (n.sum() + BUCKETS))
    ratio = np.append(log_p["target"] - log_p["raw"], 0.0) if counts["target"].sum() else np.zeros(BUCKETS + 1)
    return Model(np.round(ratio * SCALE).astype(np.int64))


def threshold(scores: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_labels: int) -> float:
    """The log weight that parts good from bad labelled rows with the least mean error of both; midway between two."""
    sample = sample_labels(labels, label_col, max_labels, id_col)
    rows = scores.join(F.broadcast(sample), id_col).select(F.col("log_weight").alias("score"), "label").toPandas().sort_values("score")
    good, bad = int((rows["label"] == 1).sum()), int((rows["label"] != 1).sum())
    if not good or not bad:
        return -math.inf
    s, y = rows["score"].to_numpy(), rows["label"].to_numpy() == 1
    lost, left = np.concatenate([[0], np.cumsum(y)]) / good, 1 - np.concatenate([[0], np.cumsum(~y)]) / bad
    edge = np.concatenate([[True], s[1:] > s[:-1], [True]])
    best = int(np.argmin(np.where(edge, lost + left, np.inf)))
    if best in (0, len(s)):
        return -math.inf if best == 0 else math.inf
    return float((s[best - 1] + s[best]) / 2)


def largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The ``k``-th largest value of the column ``key``, by counts in ever finer bins."""
    if k <= 0:
        return math.inf
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return -math.inf
    above = 0
    while high > low:
        width = (high - low) / bins
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        found = sorted(keys.where(F.col("key").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect(), reverse=True)
        for r in found:
            if above + r.n >= k:
                low, high = r.lo, r.hi
                break
            above += r.n
        else:
            return low
    return low


def gumbel(seed: int, *of: str) -> Column:
    """Noise of the standard Gumbel distribution, fixed by the seed and the columns."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in of]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


@dataclass
class Selection:
    model: Model
    cut: float
    scores: DataFrame


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 50_000, temperature: float = 1.0, seed: int = 1) -> Selection:
    """Fit, score and rank; ``cut`` is the least key that is kept, ``scores`` has ``(id_col, log_weight, n_grams, score, key)``; ``score`` is the mean log ratio."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(docs, labels, id_col, text_col, label_col, max_labels)
    scored = docs.select(id_col, model.column(F.col(text_col)).alias("of"), gumbel(seed, id_col, text_col).alias("noise"))
    score = F.col("of.log_weight") / F.greatest(F.col("of.n_grams"), F.lit(1))
    scores = scratch.keep(scored.select(id_col, "of.log_weight", "of.n_grams", score.alias("score"), (F.col("of.log_weight") / temperature + F.col("noise")).alias("key")), "scores")
    least = threshold(scores, labels, id_col, label_col, max_labels)
    k = scores.where(F.col("log_weight") >= least).count()
    return Selection(model, largest(scores, k), scores)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """A row for each document: ``(id_col, log_weight, n_grams, score, key, kept boolean)``."""
    chosen = select(docs, labels, id_col, **options)
    return chosen.scores.withColumn("kept", F.col("key") >= chosen.cut)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", temperature: float = 1.0, seed: int = 1, **options) -> DataFrame:
    """The documents that are kept, with their columns."""
    chosen = select(docs, labels, id_col, text_col, temperature=temperature, seed=seed, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), chosen.model.column(F.col(text_col)).alias("of"), gumbel(seed, id_col, text_col).alias("noise"))
    return rows.where(F.col("of.log_weight") / temperature + F.col("noise") >= chosen.cut).select("row.*")
