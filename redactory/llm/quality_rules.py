"""Quality rules: counted limits, and a calibrated logistic regression over hashed n-grams.

Method. A text's features are its byte trigrams (characters, for ASCII) and its words and word pairs,
hashed into buckets; a feature is a bucket's share of the text's n-grams of its kind. A logistic
regression is trained on labelled rows: their features are written once, and every step of the optimiser
(L-BFGS) is one pass over them, whose gradients, one for each ``TASK`` texts, are added up. A fold that the regression did
not see calibrates it (Platt): the logistic function of a line through its margins, so that the score is a
probability. Texts are scored in Arrow batches and kept if the probability of a good label is at least
``least`` and no counted rule fails.

Counted rules: words ``[^\\x20\\x09-\\x0D]+``, code points in words, characters of ``#*$%&|<>``, lines (parted by
``\\n``) with a word that equal an earlier line, and words in three-word windows that stand twice or more in the
text. A text fails if it has fewer than ``min_words`` words or if more than ``max_repeated`` percent of its words repeat.

At most about ``max_labels`` labelled ids are learned from, by a hash of the id; everything else covers all rows.
Gradients, losses and scores are sums of whole numbers: neither the model nor a score
depends on how rows are dealt out.

Defined results: a null text is an empty one; texts without words fail; of rows of one id the least text is learned
from; repeated rows have equal results; without labels of both kinds, or with none of both left for each fold, the
probability is the share of good labels (1 without labels); an empty table gives an empty table; other columns are
ignored by :func:`judge` and passed on by :func:`keep`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .quality import BUCKETS, NONE, SCALE, blocks, buckets, sample_labels
from .storage import Scratch, small_batches

#: Buckets below this are of bytes, the others of words.
BYTES = 1 << 16
#: Shares are multiplied by this, so that one step fits weights of common and rare n-grams.
SHARE = 30.0
#: Bytes of features in a row, and more by less than one text's: files are written in pages of at least 100 rows.
ROW = 1 << 14
#: Texts learned from in one task: a task gives a tensor of all buckets.
TASK = 1000
#: Gradients and losses are counted in parts of this size.
PART = float(1 << 32)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_BLANK = b" \t\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """The fixed thresholds."""

    min_words: int = 50
    max_repeated: int = 50
    least: float = 0.5


def per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``edges``."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return run[edges[1:]] - run[edges[:-1]]


def repeated_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word of many texts, whether it is in a three-word window that its text holds twice or more."""
    of = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    window = shingles.mix(shingles.grams(h, 3) + of[: max(0, len(h) - 2)] * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(of[2:] == of[:-2]) if len(h) > 2 else np.zeros(0, np.int64)
    at = at[np.argsort(window[at], kind="stable")]
    same = window[at][1:] == window[at][:-1]
    twice = at[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(at) else at
    out = np.zeros(len(h), bool)
    for k in range(3):
        out[twice + k] = True
    return out


def counted(texts: list[bytes]) -> np.ndarray:
    """``COUNTS`` of each text, texts x counts."""
    out = [np.zeros((0, len(COUNTS)), np.int64)]
    for part in blocks(texts):
        a = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        _, _, h, first = shingles.joined(part)
        space = ((a >= 9) & (a <= 13)) | (a == 32)
        lines = [[line for line in t.split(b"\n") if line.strip(_BLANK)] for t in part]
        columns = [np.diff(first), per_text(~space & (a & 0xC0 != 0x80), edges), per_text(_SYMBOL[a], edges), [len(x) - len(set(x)) for x in lines], per_text(repeated_words(h, first), first)]
        out.append(np.stack(columns, 1))
    return np.concatenate(out)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that a text has, and their shares."""
    gram, word, _, _ = buckets([text])
    at, value = [], []
    for codes in (gram, word):
        n = np.bincount(codes[codes != NONE], minlength=BUCKETS)
        there = np.flatnonzero(n)
        at.append(there)
        value.append(SHARE * n[there] / max(n.sum(), 1))
    return np.concatenate(at).astype(np.int32), np.concatenate(value).astype(np.float32)


@dataclass
class Examples:
    """Features of some labelled texts, one after the other."""

    good: np.ndarray
    sizes: np.ndarray  # buckets of each text
    buckets: np.ndarray
    shares: np.ndarray

    KINDS = {"good": np.int8, "sizes": np.int32, "buckets": np.int32, "shares": np.float32}

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Examples:
        return cls(**{name: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind) for name, kind in cls.KINDS.items()})

    def margins(self, w: np.ndarray) -> np.ndarray:
        edges = np.concatenate([[0], np.cumsum(self.sizes)])
        every = np.append(w[self.buckets] * self.shares, 0.0)
        return np.where(self.sizes > 0, np.add.reduceat(every, edges)[:-1], 0.0) + w[BUCKETS]

    def loss_and_gradient(self, w: np.ndarray) -> tuple[int, np.ndarray]:
        """In whole numbers: sums of them are the same in any order."""
        margin = self.margins(w)
        off = logistic(margin) - self.good
        loss = np.logaddexp(0, np.where(self.good == 1, -margin, margin))
        grad = np.bincount(self.buckets, np.rint(np.repeat(off, self.sizes) * self.shares * PART), BUCKETS + 1)
        grad[BUCKETS] = np.rint(off * PART).sum()
        return int(np.rint(loss * PART).sum()), grad.astype(np.int64)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(held, good, text)`` as rows of :class:`Examples`."""

    def row(held: bool, made: list) -> pa.RecordBatch:
        good, at, share = zip(*made, strict=True)
        values = {"good": good, "sizes": [len(a) for a in at], "buckets": np.concatenate(at), "shares": np.concatenate(share)}
        return pa.RecordBatch.from_pydict({"held": pa.array([held]), "n": pa.array([len(good)]), "n_good": pa.array([sum(good)])} | {name: pa.array([np.array(values[name], kind).tobytes()], pa.binary()) for name, kind in Examples.KINDS.items()})

    waiting: dict[bool, list] = {True: [], False: []}
    size = {True: 0, False: 0}
    for b in batches:
        for held, good, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at, share = features(text)
            waiting[held].append((good, at, share))
            size[held] += at.nbytes + share.nbytes
            if size[held] >= ROW:
                yield row(held, waiting[held])
                waiting[held], size[held] = [], 0
    for held, made in waiting.items():
        if made:
            yield row(held, made)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    weights: np.ndarray  # a bucket, and the last for the constant: whole numbers of 1 / SCALE
    slope: float
    offset: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        out = [np.zeros(0)]
        for part in blocks(texts):
            gram, word, at, first = buckets(part)
            total = np.full(len(part), self.weights[BUCKETS] / SCALE)
            held = np.append(self.weights[:BUCKETS], 0)
            for codes, edges in ((gram, np.minimum(at, len(gram))), (word, first)):
                total += SHARE * per_text(held[codes], edges) / SCALE / np.maximum(per_text(codes != NONE, edges), 1)
            out.append(total)
        return np.concatenate(out)

    def probability(self, texts: list[bytes]) -> np.ndarray:
        return logistic(self.slope * self.margins(texts) + self.offset)

    def column(self, text: Column) -> Column:
        """``struct<probability double, counts...>`` of a text column."""
        model = self

        @F.arrow_udf("struct<probability: double, " + ", ".join(f"{c}: long" for c in COUNTS) + ">")
        def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                texts = b.to_pylist()
                yield pa.StructArray.from_arrays([pa.array(model.probability(texts)), *map(pa.array, np.ascontiguousarray(counted(texts).T))], ["probability", *COUNTS])

        return judged(F.coalesce(text, F.lit("")).cast("binary"))


def descend(evaluate, n: int, rounds: int, memory: int = 8) -> np.ndarray:
    """Least point of a convex function by L-BFGS; ``evaluate(w)`` gives value and gradient."""
    w = np.zeros(n)
    value, grad = evaluate(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, a = -grad, []
        for s, y in reversed(past):
            a.append(s @ step / (s @ y))
            step = step - a[-1] * y
        if past:
            s, y = past[-1]
            step = step * (s @ y) / (y @ y)
        for (s, y), k in zip(past, reversed(a), strict=True):
            step = step + (k - y @ step / (s @ y)) * s
        slope, length = float(grad @ step), 1.0 if past else 1 / max(float(np.abs(grad).sum()), 1e-12)
        for _ in range(12):
            new = w + length * step
            there, found = evaluate(new)
            if there <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        if (new - w) @ (found - grad) > 1e-12:
            past = [*past[1 - memory :], (new - w, found - grad)]
        done = value - there < 1e-5 * max(value, 1e-12)
        w, value, grad = new, there, found
        if done:
            break
    return w


def calibrated(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic function that fits labels to margins, with Platt's targets."""
    n_good, n_bad = int(good.sum()), int((~good).sum())
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)

    def loss(w: np.ndarray) -> float:
        return float((np.logaddexp(0, x @ w) - target * (x @ w)).sum())

    w = np.zeros(2)
    for _ in range(100):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (target - p))
        length = 1.0
        while length > 1e-9 and loss(w + length * step) > loss(w):
            length /= 2
        w = w + length * step
        if np.abs(length * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 20_000, rounds: int = 30, decay: float = 1e-5, folds: int = 5) -> Model:
    """Train on all folds but one and calibrate on that one."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality-rules")
    small_batches(spark)
    known = sample_labels(labels, label_col, max_labels, id_col).select(F.col(id_col).alias("id"), (F.col("label") == 1).cast("int").alias("good"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("good").alias("good"))
    rows = rows.select((F.pmod(F.xxhash64("id"), F.lit(folds)) == 0).alias("held"), "good", F.col("text").cast("binary").alias("text"))

    kinds = "held boolean, n long, n_good long, good binary, sizes binary, buckets binary, shares binary"
    data = scratch.keep(rows.mapInArrow(packed, kinds), "features")
    sizes = {(r.held, label): n for r in data.groupBy("held").agg(F.sum("n").alias("n"), F.sum("n_good").alias("n_good")).collect() for label, n in ((1, r.n_good), (0, r.n - r.n_good)) if n}
    if len(sizes) < 4:
        n, good = sum(sizes.values()), sum(k for (_, g), k in sizes.items() if g)
        share = (good / n) if n else 1.0
        return Model(np.zeros(BUCKETS + 1, np.int64), 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else 500.0 if share else -500.0)
    n = sizes[False, 0] + sizes[False, 1]
    learned = data.where("NOT held").select(*Examples.KINDS).coalesce(max(1, n // TASK))

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        held = spark.sparkContext.broadcast(w)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad = 0, np.zeros(BUCKETS + 1, np.int64)
            for b in batches:
                more, of_batch = Examples.of(b).loss_and_gradient(held.value)
                loss, grad = loss + more, grad + of_batch
            yield pa.RecordBatch.from_pydict({"loss": pa.array([loss]), "grad": pa.array([grad.tobytes()], pa.binary())})

        sums = learned.mapInArrow(add, "loss long, grad binary").collect()
        held.unpersist()
        penalty = np.append(w[:BUCKETS], 0.0)
        grad = sum(np.frombuffer(r.grad, np.int64) for r in sums)
        return sum(r.loss for r in sums) / PART / n + decay / 2 * float(penalty @ penalty), grad / PART / n + decay * penalty

    weights = np.rint(descend(evaluate, BUCKETS + 1, rounds) * SCALE).astype(np.int64)

    exact = weights / SCALE

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Examples.of(b)
            yield pa.RecordBatch.from_pydict({"margin": found.margins(exact), "good": found.good})

    held = data.where("held").select(*Examples.KINDS).mapInArrow(scored, "margin double, good byte").toPandas().sort_values(["margin", "good"])
    margin, good = held["margin"].to_numpy(), held["good"].to_numpy()
    return Model(weights, *calibrated(margin, good == 1))


def verdict(of: Column, rules: Rules) -> tuple[Column, Column]:
    """Whether the counted rules fail, and whether the text stays."""
    failed = (of["n_words"] < rules.min_words) | (100 * of["n_repeat_words"] > rules.max_repeated * of["n_words"])
    return failed, ~failed & (of["probability"] >= rules.least)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None, model: Model | None = None, **options) -> DataFrame:
    """A row for each document: ``(id_col, counts..., base_failed boolean, probability double, kept boolean)``."""
    rules, model = rules or Rules(), model or fit(docs, labels, id_col, text_col, **options)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), model.column(F.col(f"`{text_col}`")).alias("of"))
    failed, kept = verdict(F.col("of"), rules)
    return rows.select(F.col("id").alias(id_col), *[f"of.{c}" for c in COUNTS], failed.alias("base_failed"), "of.probability", kept.alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None, model: Model | None = None, **options) -> DataFrame:
    """The documents that stay, with their columns."""
    rules, model = rules or Rules(), model or fit(docs, labels, id_col, text_col, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), model.column(F.col(f"`{text_col}`")).alias("of"))
    return rows.where(verdict(F.col("of"), rules)[1]).select("row.*")
