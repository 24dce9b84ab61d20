"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Method. Two words are alike by the subsequences of three letters that they share,
gaps allowed: an occurrence that spans ``s`` letters weighs ``DECAY ** s``, up to
``SPAN`` letters, and word ends count as letters. So gapped words and words with inserted
characters stay near their originals. Landmarks are words of labelled documents:
those that mark toxic ones, the words most like them that do not, and common ones.
The kernel with the landmarks, whitened (Nyström), is the input of a linear
support vector machine over words. As its decision is linear in the kernel, and
the kernel in the subsequences, it is kept as one weight for each subsequence: a word costs
a few table lookups however many landmarks there are. A document's score is a
logistic function of its largest word margin, of the positive ones among its four
largest, of how many words are above each of ``ABOVE``, and of its length; words that are
not there count as none, so that short texts are judged by the words they have. The
weights come from the same labelled documents.

Only labelled rows of the training folds are learned from, about ``max_labels`` of
them at most; ids, languages, sources and labels are never inputs of a score.
Single characters in a row ("i d i o t") are also read as one word.

Defined results: null and empty texts have no words and get the score of a text
of length 0 without positive margins; repeated rows get equal scores; without toxic and
other labels to learn from every score is the share of toxic labels (0 without
labels); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

SPAN, DECAY = 6, 0.5
#: Letters of a piece of a word; longer words are read in overlapping pieces.
PIECE = 24
TOP = 4
LOWEST = -2.0
#: The least that a largest margin counts, and margins above which words are counted.
FLOOR = -0.5
ABOVE = (0.0, 0.25, 0.5, 1.0)
WIDTH = TOP + len(ABOVE) + 3
REMEMBERED = 300_000
#: 0 stands for the ends of a word; Latin letters with marks share five codes, letters of other scripts are dealt out over all.
_CODE = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")} | dict.fromkeys("é", 27) | dict.fromkeys("èêë", 28) | dict.fromkeys("äàâáå", 29) | dict.fromkeys("öóôòüúùûïîíì", 30) | dict.fromkeys("çßñ", 31)
_INSTEAD = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_LETTER = {ord(c): n for c, n in _CODE.items()} | {ord(a): _CODE[b] for a, b in _INSTEAD.items()}
_ENDS = re.compile(r"^[^\w]+|[^\w]+$")
_SINGLES = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _code(ch: str) -> int | None:
    """A letter's code; what is neither a letter nor stands for one has none."""
    code = _LETTER.get(ord(ch))
    return code if code is not None or not ch.isalpha() else 1 + (ord(ch) * 0x9E3779B1 >> 13) % 31


def letters(word: str) -> list[int]:
    """Codes of a word's letters, without signs at its ends and without other characters inside."""
    return [c for ch in _ENDS.sub("", word.lower()) if (c := _code(ch)) is not None]


def matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words' pieces with both ends, lengths, and the word of each piece."""
    pieces, of = [], []
    for i, w in enumerate(words):
        c = letters(w)
        if not c:
            continue
        for at in range(0, max(1, len(c) - PIECE // 2), PIECE // 2):
            part = c[at : at + PIECE]
            pieces.append(([0] if at == 0 else []) + part + ([0] if at + PIECE >= len(c) else []))
            of.append(i)
    size = np.array([len(p) for p in pieces], np.int64)
    out = np.zeros((len(pieces), int(size.max()) if len(size) else 0), np.int32)
    for r, p in enumerate(pieces):
        out[r, : len(p)] = p
    return out, size, np.array(of, np.int64)


def _norms() -> np.ndarray:
    """By length: the root of the sum of squared weights of all subsequences."""
    out = np.ones(PIECE + 3)
    for n in range(3, PIECE + 3):
        out[n] = np.sqrt(sum((n - b) * DECAY ** (2 * (b + 1)) for a, b in _OFFSETS if n > b))
    return out


_NORM = _norms()


def each_subsequence(codes: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Subsequence numbers, which of them exist, and their weight."""
    for a, b in _OFFSETS:
        if codes.shape[1] > b:
            n = codes.shape[1] - b
            yield (codes[:, :n] << 10) | (codes[:, a : a + n] << 5) | codes[:, b:], np.arange(n) < (size - b)[:, None], DECAY ** (b + 1)


def profiles(words: list[str]) -> np.ndarray:
    """Normed weights of all subsequences, 32768 x words (first pieces): for landmarks, which are few."""
    codes, size, of = matrix(words)
    first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
    out = np.zeros((1 << 15, len(words)), np.float32)
    for index, there, weight in each_subsequence(codes, size):
        row = np.broadcast_to(of[:, None], index.shape)
        keep = there & first[:, None]
        np.add.at(out, (index[keep], row[keep]), weight)
    norm = np.ones(len(words), np.float32)
    norm[of[first]] = _NORM[size[first]]
    return out / norm


def kernel(words: list[str], base: np.ndarray, block: int = 500) -> np.ndarray:
    """The normed kernel of words (first pieces) with the landmarks of ``base`` (:func:`profiles`)."""
    out = np.zeros((len(words), base.shape[1]), np.float32)
    for at in range(0, len(words), block):
        codes, size, of = matrix(words[at : at + block])
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        codes, size, of = codes[first], size[first], of[first]
        for index, there, weight in each_subsequence(codes, size):
            for column in range(index.shape[1]):
                keep = there[:, column]
                out[at + of[keep]] += np.float32(weight) * base[index[keep, column]]
        out[at + of] /= _NORM[size, None].astype(np.float32)
    return out


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    document: np.ndarray  # of the features of a document
    share: float
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def margins(self, words: list[str]) -> np.ndarray:
        """The largest margin of each word's pieces; words without letters have the lowest."""
        codes, size, of = matrix(words)
        total = np.zeros(len(of))
        for index, there, weight in each_subsequence(codes, size):
            total += weight * np.where(there, self.weight[index], 0).sum(1)
        out = np.full(len(words), LOWEST)
        np.maximum.at(out, of, np.clip(total / _NORM[size] + self.bias, LOWEST, -LOWEST))
        return out

    def document_features(self, texts: list[str]) -> np.ndarray:
        split = [t.split() for t in texts]
        for words, t in zip(split, texts, strict=True):
            if _SINGLES.search(t):
                words += [x.replace(" ", "") for x in _SINGLES.findall(t)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            known.update(zip(part, self.margins(part).tolist(), strict=True))
        out = np.zeros((len(texts), WIDTH))
        for i, words in enumerate(split):
            m = np.array([known[w] for w in words])
            best = np.sort(m[m > 0])[::-1]
            out[i, : min(TOP, len(best))] = best[:TOP]
            out[i, TOP : TOP + len(ABOVE)] = [np.log1p((best > t).sum()) for t in ABOVE]
            out[i, -3:] = max(FLOOR, m.max(initial=FLOOR)), np.log1p(len(words)), 1
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.weight.any():
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-(self.document_features(texts) @ self.document)))

    def margin_column(self, word: Column) -> Column:
        model = self

        @F.arrow_udf("double")
        def margin(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                yield pa.array(model.margins(b.to_pylist()))

        return margin(word)

    def column(self, text: Column) -> Column:
        model = self

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                yield pa.array(model.score([t or "" for t in b.to_pylist()]))

        return scored(text)


def held_out(id_col: str) -> Column:
    """The fold that is never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labels: int) -> DataFrame:
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg((F.max(label_col) == 1).alias("__toxic"))
    n = known.count()
    if n > max_labels:
        known = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(max_labels / n * (1 << 30)))
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(known), id_col).select("text", F.col("__toxic").alias("toxic"))


def _pieces(word: str) -> list[str]:
    """A word, or the overlapping pieces in which a long one is read."""
    return [word[at : at + PIECE] for at in range(0, max(1, len(word) - PIECE // 2), PIECE // 2)] if word else []


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents of a task have each word."""
    counts: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "toxic": pa.array([c[1] for c in counts.values()], pa.int64()), "other": pa.array([c[0] for c in counts.values()], pa.int64())})
        counts.clear()
        return out

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for word in {p for w in text.split() for p in _pieces(_ENDS.sub("", w.lower()))}:
                counts.setdefault(word, [0, 0])[toxic] += 1
        if len(counts) > 500_000:
            yield flush()
    yield flush()


def _varied(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word once with an inserted letter."""
    out = []
    for w in words:
        at = int(rng.integers(1, max(2, len(w))))
        out.append(w[:at] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + w[at:])
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Adam; ``x`` stays in single precision."""
    x, y, weight = x.astype(np.float32, copy=False), y.astype(np.float32), weight.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    first, second = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * y * weight
        grad = np.append(ridge * w - slack @ x, -slack.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = (0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)).astype(np.float32)
        w, b = w - move[:-1], b - move[-1]
    return w.astype(float), float(b)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w


def _machine(marking: pd.DataFrame, plain: pd.DataFrame, landmarks: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Choose landmarks, whiten their kernel, train; returns a weight for each subsequence, and the bias."""
    yes, no = marking["word"].to_list(), plain["word"].to_list()
    third = landmarks // 3
    like = kernel(no, profiles(yes[:third])).max(1)
    near = [no[i] for i in np.argsort(-like, kind="stable")[:third]]
    chosen = list(dict.fromkeys(yes[:third] + near + no[: landmarks - 2 * third]))
    base = profiles(chosen)
    value, vector = np.linalg.eigh(kernel(chosen, base).astype(float))
    white = (vector * (1 / np.sqrt(np.maximum(value, 1e-3)))) @ vector.T
    varied = _varied(yes, rng)
    features = kernel(yes + varied + no, base) @ white.astype(np.float32)
    y = np.repeat([1.0, -1.0], [len(yes) + len(varied), len(no)])
    heavy = np.concatenate([np.tile(np.log1p(marking["toxic"].to_numpy(float)), 2) * np.repeat([1.0, 0.3], len(yes)), np.log1p(plain["other"].to_numpy(float))])
    heavy[y > 0] *= 0.3 / heavy[y > 0].sum()
    heavy[y < 0] *= 0.7 / heavy[y < 0].sum()
    w, bias = _svm(features, y, heavy)
    return (base @ (white @ w)).astype(np.float32), bias


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labels: int = 30_000, landmarks: int = 384, mining: int = 2, seed: int = 7, marking_words: int = 1000, plain_words: int = 6000, hard_words: int = 5000, least_docs: int = 3, least_lift: float = 4.0) -> Model:
    """Train on the folds that are not held out.

    Examples of the machine are words: labels are of documents, and what makes a document
    toxic is found among its words. ``marking_words`` are at least ``least_lift`` times as common in toxic documents, and in
    ``least_docs`` of them; ``plain_words`` and, in each of ``mining`` turns, ``hard_words`` stand against them. What
    reaches the driver: these words and a few numbers for each of ``max_labels`` documents.
    """
    small_batches(docs.sparkSession)
    rows = _labelled(docs, labels, id_col, text_col, label_col, max_labels)
    n = rows.groupBy("toxic").count().collect()
    bad, good = (next((r["count"] for r in n if r.toxic is t), 0) for t in (True, False))
    nothing = Model(np.zeros(1 << 15, np.float32), 0.0, np.zeros(WIDTH), bad / max(1, bad + good))
    if not bad or not good:
        return nothing
    words = rows.mapInArrow(_count_words, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    lift = (F.col("toxic") / bad) / ((F.col("other") + 0.5) / good)
    words = words.withColumn("lift", lift).withColumn("marks", (F.col("toxic") >= least_docs) & (lift >= least_lift)).cache()
    marking = words.where("marks").orderBy(F.desc(F.col("toxic") * F.log("lift")), "word").limit(marking_words).toPandas()
    plain = words.where("NOT marks AND lift < 2").orderBy(F.desc(F.col("toxic") + F.col("other")), "word").limit(plain_words).toPandas()
    if not len(marking) or not len(plain):
        words.unpersist()
        return nothing

    model = nothing
    rng = np.random.default_rng(seed)
    for turn in range(1 + mining):
        if turn:  # words of clean documents that the machine takes for toxic ones
            hard = words.where("NOT marks AND lift < 2 AND other > 0").withColumn("margin", model.margin_column(F.col("word"))).where("margin > -0.5")
            hard = hard.orderBy(F.desc("margin"), "word").limit(hard_words).drop("margin").toPandas()
            plain = pd.concat([plain, hard]).drop_duplicates("word")
        weight, bias = _machine(marking, plain, landmarks, rng)
        model = Model(weight, bias, np.zeros(WIDTH), nothing.share)
    words.unpersist()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = model.document_features(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    seen = rows.mapInArrow(gather, "x array<double>, toxic boolean").toPandas()
    model.document = _logistic(np.stack(seen["x"].to_list()), seen["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, **options) -> DataFrame:
    """A row for each document: ``(id_col, held_out, score, predicted int)``."""
    model = fit(docs, labels, id_col, text_col, **options)
    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), model.column(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
