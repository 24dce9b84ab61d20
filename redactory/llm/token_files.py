"""Token ids in flat binary files with 64-bit document offsets.

Method. Documents are dealt out by ranges of their id and sorted, so that file
``k`` holds the ids of the ``k``-th range. Each task encodes its documents and
writes one flat file of little-endian unsigned ids (16 bits if the vocabulary has
up to 65,536 of them, else 32) and one of document ids and lengths. The files' sizes give each file's base by a prefix sum; a second
pass writes 64-bit offsets (base plus the lengths before) beside the ids. Readers
map the files into memory and slice a document by its offsets.

A task writes under a name of its own attempt and renames the file when it is
complete, and a repeated task writes the same bytes: a lost executor or a second
attempt changes nothing.

Defined results: a null text counts as empty, whose only id is the end id; rows without
an id come before all others and are read back without one; repeated rows are kept, rows of one doc_id in the order of their texts; an empty
table gives no files and no rows; other columns are ignored. Texts that look like
special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.changelog import qualified
from .storage import small_batches

#: Stands for no id in files.
NO_ID = -(2**63)
#: Pieces of text whose ids a worker remembers; as many words, and as many ends of pieces. Beyond that it begins anew.
REMEMBERED = 700_000
#: Characters that those pieces, words or ends may have together: texts without spaces are pieces of any length.
REMEMBERED_CHARS = 20_000_000
#: Bytes of texts that are in pieces at a time; a longer text is alone.
TOGETHER = 4_000_000
#: A piece's first word of Latin letters, if a character follows that certainly is no letter, and the rest of the piece.
_WORD = re.compile(r"((?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++(?=[\x00-@\[-`{-\x7f]))?)([^ ]*) ")

_workers: dict = {}


class _Pieces:
    """Pieces of text, numbered as they come, and the ids of each. A piece without ids of its own starts at -1."""

    def __init__(self, kind: str):
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.start, self.size = np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)
        self.chars = 0

    def numbers(self, pieces: Iterable[str], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Numbers of pieces; ``learn`` gives ids of new ones, with the start and size of each."""
        found = np.fromiter(map(self.number.__getitem__, pieces), np.int64)
        if new := len(self.number) - len(self.size):
            ids, start, size = learn(pieces := list(islice(reversed(self.number), new))[::-1])
            self.chars += sum(map(len, pieces))
            start = np.where(start < 0, -1, start + len(self.ids))
            self.ids, self.start, self.size = (np.concatenate(x) for x in ((self.ids, ids), (self.start, start), (self.size, size)))
        return found

    def taken(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one piece after the other, and how many each has."""
        return _taken(self.ids, self.start[numbers], self.size[numbers]), self.size[numbers]


def _taken(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return ids[np.repeat(start - size.cumsum() + size, size) + np.arange(size.sum())]


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct piece of text once.

    A byte-level pre-tokenizer never joins what stands before a single space
    with the visible character after it, so ``text.split(" ")`` gives pieces that
    are encoded apart. A piece that is empty or begins with white space (several
    spaces in a row, a space before a line break) has no such boundary; it is
    encoded together with the piece before. The same pre-tokenizer ends a word where its
    letters end, so that the rest of a piece is encoded apart from its first word.

    Pieces are numbered, and the ids of texts are gathered by these numbers. The first
    piece of a text, which follows no space, is known by a name that begins with one.

    Texts for other kinds of tokenizers are encoded whole.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        said = json.loads(self.tokenizer.to_str())
        before, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        special = all(t.get("special") for t in said.get("added_tokens") or [])
        self.apart = usual.items() <= before.items() and said.get("normalizer") is None and model.get("type") == "BPE" and plain and special
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.words, self.ends = (_Pieces(self.kind) for _ in range(3))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def flat(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // np.dtype(self.kind).itemsize
        return np.frombuffer(b"".join(coded), self.kind), size.cumsum() - size, size

    def together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces that each follow a space and hold none: many are one text, as each begins with an id that begins with a space."""
        ids = self.flat([self.whole([" ".join(["", *pieces[at : at + 1000]])])[0] for at in range(0, len(pieces), 1000)])[0]
        start = np.flatnonzero(self.begins[ids])
        return (ids, start, np.diff(start, append=len(ids))) if len(start) == len(pieces) else self.flat(self.whole([f" {p}" for p in pieces]))

    def bound(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces that each follow a space and hold none: of first words, and of what follows those."""
        parts = _WORD.findall(" ".join([*pieces, ""]))
        words = self.words.numbers([w or rest for w, rest in parts], self.together)
        ends = self.ends.numbers([rest if w else "" for w, rest in parts], lambda new: self.flat(self.whole(new)))
        start = np.stack([self.words.start[words], len(self.words.ids) + self.ends.start[ends]], 1)
        size = np.stack([self.words.size[words], self.ends.size[ends]], 1)
        ids, size = _taken(np.concatenate([self.words.ids, self.ends.ids]), start.ravel(), size.ravel()), size.sum(1)
        return ids, size.cumsum() - size, size

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, with the start and size of each; those without a boundary before them have none."""
        bound, others = [], []
        for k, p in enumerate(new):
            if " " in p:
                others.append(k)
            elif p and not p[0].isspace():
                bound.append(k)
        ids, _, sizes = zip(self.bound([new[k] for k in bound]), self.flat(self.whole([new[k][1:] if new[k][0] == " " else f" {new[k]}" for k in others])), strict=True)
        order, sizes = np.array(bound + others, np.int64), np.concatenate(sizes)
        start, size = np.full(len(new), -1), np.zeros(len(new), np.int64)
        start[order], size[order] = sizes.cumsum() - sizes, sizes
        return np.concatenate(ids), start, size

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.apart:
            return self.whole(texts.to_pylist())
        out, at, last = [], 0, np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        try:
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(last, TOGETHER + (last[at - 1] if at else 0), "right")))
                out += self.by_pieces(texts[at:to])
                at = to
        except BaseException:
            self.forget()  # pieces may have numbers, but no ids yet
            raise
        return out

    def by_pieces(self, texts: pa.Array) -> list[bytes]:
        for kept in ("known", "words", "ends"):
            if len(getattr(self, kept).number) > REMEMBERED or getattr(self, kept).chars > REMEMBERED_CHARS:
                setattr(self, kept, _Pieces(self.kind))
        split = pc.split_pattern(texts, " ")
        pieces, n = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
        found, first = pieces.dictionary_encode(), n.cumsum() - n
        numbers = self.known.numbers(found.dictionary.to_numpy(zero_copy_only=False), self.learn)[found.indices.to_numpy()]
        numbers[first] = self.known.numbers([f" {p}" for p in pieces.take(pa.array(first)).to_pylist()], self.learn)
        out = self.gathered(numbers, n)
        if loose := [k for k, x in enumerate(out) if x is None]:
            again = [self.joined(texts[k].as_py().split(" ")) for k in loose]
            numbers = self.known.numbers(chain.from_iterable(again), self.learn)
            for k, x in zip(loose, self.gathered(numbers, np.array([len(s) for s in again])), strict=True):
                out[k] = x
        return out

    def gathered(self, numbers: np.ndarray, n: np.ndarray) -> list[bytes | None]:
        """Ids of texts of ``n`` pieces each; None where a piece has no boundary before it."""
        (ids, size), last = self.known.taken(numbers), n.cumsum()
        at, data = np.concatenate([[0], size.cumsum()]) * ids.itemsize, ids.tobytes()
        loose = set(np.searchsorted(last, np.flatnonzero(self.known.start[numbers] < 0), "right").tolist())
        return [None if k in loose else data[a:b] for k, (a, b) in enumerate(zip(at[last - n].tolist(), at[last].tolist(), strict=True))]

    @staticmethod
    def joined(pieces: list[str]) -> list[str]:
        """Pieces without a boundary before them are put to the piece before."""
        groups = [[f" {pieces[0]}"]]
        for p in pieces[1:]:
            if p and not p[0].isspace():
                groups.append([p])
            else:
                groups[-1].append(p)
        return [" ".join(g) for g in groups]


def worker(vocabulary: str) -> WordEncoder:
    if vocabulary not in _workers:
        _workers[vocabulary] = WordEncoder(vocabulary)
    return _workers[vocabulary]


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system of tasks for a folder. Hadoop's names of S3 are known too; other schemes must be ones that Arrow knows."""
    scheme, _, rest = uri.partition("://")
    if not rest and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    try:
        return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"token files cannot be written to {uri}: a scheme of Arrow's file systems is needed (file, hdfs, s3, s3a, gs, abfs)") from e


class _File:
    """A file that appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str, attempt: str):
        self.fs, path = _store(folder)
        self.final, self.own = f"{path}/{name}", f"{path}/.{name}.{attempt}"
        self.out = self.fs.open_output_stream(self.own)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.final)


def write(df: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Write the files below ``folder``; return ``(shard int, width int, base long, n_docs long, n_ids long)``, a row a file; ``width`` is bytes an id.

    ``folder`` without a scheme is of Hadoop's default file system, for tasks too. Files that tasks wrote and the driver does not see
    are an error: the folder is then each machine's own.
    ``files`` defaults to the number of shuffle partitions. The rows returned are
    as many as there are files, not documents.
    """
    spark = df.sparkSession
    small_batches(spark)
    files, folder = files or int(spark.conf.get("spark.sql.shuffle.partitions")), qualified(spark, folder)
    _make(spark, folder)

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker(vocabulary)
        task = TaskContext.get()
        shard, attempt, end = task.partitionId(), str(task.taskAttemptId()), np.array([end_id], encoder.kind).tobytes()
        ids = lengths = None
        n_docs = n_ids = 0
        for b in batches:
            if not b.num_rows:
                continue
            if ids is None:
                ids, lengths = (_File(folder, f"{kind}-{shard:06d}", attempt) for kind in ("ids", "docs"))
            coded = [x + end for x in encoder.encode(b.column(1))]
            ids.out.write(b"".join(coded))
            size = np.fromiter((len(x) // len(end) for x in coded), np.int64, len(coded))
            lengths.out.write(np.stack([b.column(0).to_numpy(zero_copy_only=False), size], 1).astype("<i8").tobytes())
            n_docs, n_ids = n_docs + len(coded), n_ids + int(size.sum())
        if ids is not None:
            ids.close()
            lengths.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "width": pa.array([len(end)], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = rows.repartitionByRange(files, "id", F.substring("text", 1, 16)).sortWithinPartitions("id", "text").mapInArrow(write_shard, "shard int, width int, n_docs long, n_ids long").collect()
    base, table = 0, []
    for r in sorted(sizes):
        table.append((r.shard, r.width, base, r.n_docs, r.n_ids))
        base += r.n_ids
    if lost := {f"ids-{r.shard:06d}" for r in sizes} - set(_names(spark, folder, "ids-*")):
        raise ValueError(f"executors do not share {folder}: {len(lost)} of {len(sizes)} files that they wrote are not there")
    shards = spark.createDataFrame(table, "shard int, width int, base long, n_docs long, n_ids long").repartition(max(1, len(table)), "shard")
    shards.foreachPartition(_offsets_writer(folder))
    _tidy(spark, folder)
    return shards


def _offsets_writer(folder: str):
    def write_offsets(rows) -> None:
        attempt = str(TaskContext.get().taskAttemptId())
        for r in rows:
            fs, path = _store(folder)
            with fs.open_input_file(f"{path}/docs-{r.shard:06d}") as docs:
                size = np.frombuffer(docs.read(), "<i8").reshape(-1, 2)[:, 1]
            out = _File(folder, f"offsets-{r.shard:06d}", attempt)
            out.out.write((r.base + np.concatenate([[0], np.cumsum(size)])).astype("<u8").tobytes())
            out.close()

    return write_offsets


def _opened(folder: str, name: str, kind: str) -> Callable[[int, int], np.ndarray]:
    """A file's numbers from one place to another: mapped into memory where the store is a file system of this machine, else read piece by piece."""
    fs, path = _store(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        whole = np.memmap(f"{path}/{name}", kind, "r")
        return lambda a, b: whole[a:b]
    f, width = fs.open_input_file(f"{path}/{name}"), np.dtype(kind).itemsize
    return lambda a, b: np.frombuffer(f.read_at((b - a) * width, a * width), kind)


def read(shards: DataFrame, folder: str, block: int = 10_000) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` for each document, from the files alone."""
    folder = qualified(shards.sparkSession, folder)

    def read_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, width, base, n in zip(*(b[c].to_pylist() for c in ("shard", "width", "base", "n_docs")), strict=True):
                ids, docs, offsets = _opened(folder, f"ids-{shard:06d}", f"<u{width}"), _opened(folder, f"docs-{shard:06d}", "<i8"), _opened(folder, f"offsets-{shard:06d}", "<u8")
                for lo in range(0, n, block):
                    hi = min(lo + block, n)
                    at = offsets(lo, hi + 1).astype(np.int64)
                    crc = [zlib.crc32(ids(i - base, j - base).astype("<u4")) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    doc = docs(2 * lo, 2 * hi)[::2]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64(), mask=doc == NO_ID), "start": pa.array(at[:-1]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())})

    return shards.select("shard", "width", "base", "n_docs").mapInArrow(read_shard, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _tidy(spark: SparkSession, folder: str) -> None:
    """Delete what failed attempts of tasks left."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in _names(spark, folder, ".*.*"):
        if name.split("-")[0] in (".ids", ".docs", ".offsets"):
            fs.delete(path(folder, name), False)


def _names(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files of a folder as the driver sees them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, pattern)
    return [found.getPath().getName() for found in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []]


def _make(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
