"""Vector code compression: codebooks of product quantisation over whole numbers.

Method. Vectors become whole numbers and are packed, dimension by dimension, into blocks of
NumPy columns, which are the elements of an RDD. In each round a block's parts are assigned to the
nearest entries of their codebooks (squared distances accumulate one dimension after the
other), ``np.add.at`` adds up members and counts in tensors of whole numbers, and
``treeAggregate`` merges the tensors, so that what reaches the driver is one tensor of the size of the
codebooks for each branch of the last level, however many vectors there are. An entry becomes
the floor of its members' mean. All sums are of whole numbers: results do not depend on how rows are dealt out.

The first codebooks are the vectors of the least ids. Components become ``floor(scale * x)``; the kind
of integers is chosen by the largest component, so that no distance and no sum can
overflow: 32 bits, 64 bits, or Python's unbounded ones.

Defined results: vectors that are null, empty, of another length than the kept vector of
the least id, or that hold null or non-finite components take no part; rows of one id count each
and are in the order of their vectors, rows without id come last; ties of distance go to the lower index; an entry
without members stays; with fewer vectors than entries the codebooks are smaller; lengths that ``parts`` does not
divide give the first parts one component more; sums of errors that do not fit in 64 bits are null, and
so is an error; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch

#: Vectors of a block, and of those looked at together.
BLOCK, STEP = 4096, 256
#: Branches of the tree that merges tensors.
BRANCHES = 16
#: Labels of at least one row in so many: there are at most as many of them.
HOT = 1000


@dataclass(frozen=True)
class Numbers:
    """How components become whole numbers, and where parts begin."""

    scale: int
    edges: tuple[int, ...]  # one more than parts
    kind: str  # "i4", "i8" or "O"

    @classmethod
    def chosen(cls, scale: int, dim: int, parts: int, most: float, rows: int) -> Numbers:
        size, longer = divmod(dim, parts)
        edges = tuple(p * size + min(p, longer) for p in range(parts + 1))
        bound = math.ceil(most) * scale + 1
        far = dim * (2 * bound) ** 2
        return cls(scale, edges, "i4" if far < 2**31 else "i8" if far < 2**63 and bound * rows < 2**63 else "O")

    def whole(self, x: np.ndarray) -> np.ndarray:
        """Vectors (rows) as columns of whole numbers."""
        if self.kind == "O":
            out = np.empty(x.T.shape, object)
            for at, v in np.ndenumerate(x.T):
                out[at] = int(v) * self.scale if abs(v) >= 2**60 else math.floor(float(v) * self.scale)
            return out
        return np.floor(x.T * float(self.scale)).astype(self.kind)

    def pack(self, x: np.ndarray) -> bytes:
        """Vectors (rows) as the bytes of a block."""
        return np.ascontiguousarray(x.T, "<f8").tobytes() if self.kind == "O" else np.ascontiguousarray(self.whole(x), f"<{self.kind}").tobytes()

    def unpack(self, data: bytes) -> np.ndarray:
        dim = self.edges[-1]
        if self.kind == "O":
            return self.whole(np.frombuffer(data, "<f8").reshape(dim, -1).T)
        return np.frombuffer(data, f"<{self.kind}").reshape(dim, -1)


def assign(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each vector of a part; ``columns`` is dimensions x vectors, ``book`` entries x dimensions."""
    n = columns.shape[1]
    code, far = np.zeros(n, np.int64), np.zeros(n, columns.dtype)
    book = book.astype(columns.dtype)
    for at in range(0, n, STEP):
        total = np.zeros((min(STEP, n - at), len(book)), columns.dtype)
        for d, column in enumerate(columns[:, at : at + STEP]):
            apart = column[:, None] - book[None, :, d]
            apart *= apart
            total += apart
        code[at : at + STEP] = near = total.argmin(1)
        far[at : at + STEP] = total[np.arange(len(near)), near]
    return code, far


@dataclass
class Codebooks:
    numbers: Numbers
    books: list[np.ndarray]  # a part's entries x dimensions

    def parts(self, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        e = self.numbers.edges
        return ((columns[a:b], book) for a, b, book in zip(e[:-1], e[1:], self.books, strict=True))

    def encode(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (vectors x parts) and squared distances of whole vectors."""
        near = [assign(x, book) for x, book in self.parts(columns)]
        wide = object if self.numbers.kind == "O" else np.int64
        return np.stack([c for c, _ in near], 1).astype(np.uint8), sum(far.astype(wide) for _, far in near)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for, in the scale of the originals."""
        return np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], 1).astype(float) / self.numbers.scale

    def added(self, columns: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sums (dimensions x entries) and counts of each part's members."""
        out, wide = [], object if self.numbers.kind == "O" else np.int64
        for x, book in self.parts(columns):
            code, _ = assign(x, book)
            sums, counts = np.zeros((len(x), len(book)), wide), np.zeros(len(book), np.int64)
            for total, column in zip(sums, x, strict=True):
                np.add.at(total, code, column.astype(wide))
            np.add.at(counts, code, 1)
            out.append((sums, counts))
        return out

    def moved(self, tensors: list[tuple[np.ndarray, np.ndarray]]) -> Codebooks:
        """Entries at the floors of their members' means."""
        books = []
        for book, (sums, counts) in zip(self.books, tensors, strict=True):
            new, used = book.copy(), counts > 0
            new[used] = (sums[:, used] // counts[used]).T
            books.append(new)
        return Codebooks(self.numbers, books)

    def sha256(self) -> str:
        """Of all entries' components, by part, entry and place."""
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()


def merged(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return b if a is None else a
    return [(s + t, m + n) for (s, m), (t, n) in zip(a, b, strict=True)]


def taking_part(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``(id, label, v array<double>)`` of vectors of any length that hold finite numbers alone."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.where("v IS NOT NULL AND size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def _matrix(v: pa.Array, dim: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def train(rows: DataFrame, scratch: Scratch, parts: int, entries: int, rounds: int, scale: int) -> Codebooks | None:
    """Codebooks of the rows of :func:`taking_part`; nothing, if there are none."""
    if not 1 <= entries <= 256:
        raise ValueError("codes have a byte a part: from 1 to 256 entries")
    order = [F.col("id").isNull(), F.col("id"), F.col("v")]
    first = rows.orderBy(*order).select(F.size("v").alias("dim")).first()
    if first is None:
        return None
    dim = first.dim
    rows = rows.where(F.size("v") == dim)
    most, n = rows.agg(F.max(F.array_max(F.transform("v", F.abs))), F.count("*")).first()
    numbers = Numbers.chosen(scale, dim, parts, most, n)
    start = numbers.whole(np.array([r.v for r in rows.orderBy(*order).select("v").limit(entries).collect()]).reshape(-1, dim))
    wide = start.astype(object if numbers.kind == "O" else np.int64)
    found = Codebooks(numbers, [np.ascontiguousarray(wide[a:b].T) for a, b in zip(numbers.edges[:-1], numbers.edges[1:], strict=True)])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            x = _matrix(b.column(0), dim)
            for at in range(0, len(x), BLOCK):
                held.append(x[at : at + BLOCK])
                size += len(held[-1])
                if size >= BLOCK:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([numbers.pack(np.concatenate(held))], pa.binary())})
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_pydict({"block": pa.array([numbers.pack(np.concatenate(held))], pa.binary())})

    blocks = scratch.keep(rows.select("v").mapInArrow(packed, "block binary"), "blocks").rdd.map(lambda r: r.block)
    depth = max(2, math.ceil(math.log(max(blocks.getNumPartitions(), 2), BRANCHES)))
    for _ in range(rounds):
        books = rows.sparkSession.sparkContext.broadcast(found)
        found = found.moved(blocks.treeAggregate(None, lambda sums, block, books=books: merged(sums, books.value.added(books.value.numbers.unpack(block))), merged, depth))
        books.unpersist()
    return found


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``(id, label, code string, error long)``: two hex digits a part, and the squared distance to what the code stands for."""
    numbers, dim, parts = books.numbers, books.numbers.edges[-1], len(books.books)
    rows = rows.where(F.size("v") == dim)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = books.encode(numbers.whole(_matrix(b.column(2), dim)))
            digits = codes.tobytes().hex()
            code = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
            fits = [int(e) if e < 2**63 else None for e in error] if numbers.kind == "O" else error
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(fits, pa.int64())], ["id", "label", "code", "error"])

    return rows.mapInArrow(coded, T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def with_label_error(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``label_error``, the sum over rows of one label.

    Labels of at least one row in ``HOT`` are at most ``HOT`` labels: their sums are broadcast, and only the rows of
    rarer labels are shuffled.
    """
    sums = scratch.keep(rows.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "label-sums")
    labels, total = sums.agg(F.count("*"), F.sum("n")).first()
    frequent = (F.col("n") * HOT >= total) if labels > HOT else F.lit(True)

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right.select(F.col("label").alias("of"), "label_error"), F.col("label").eqNullSafe(F.col("of")), how)

    out = joined(rows, F.broadcast(sums.where(frequent)), "inner").drop("of")
    if labels > HOT:
        rare = rows.join(F.broadcast(sums.where(frequent).select(F.col("label").alias("of"))), F.col("label").eqNullSafe(F.col("of")), "left_anti")
        out = out.unionByName(joined(rare, sums.where(~frequent), "inner").drop("of"))
    return out


def compress(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks | None]:
    """Rows ``(id_col, code, error, label_error)`` and the codebooks (none without vectors)."""
    scratch = Scratch(df.sparkSession, "vector-codes")
    rows = taking_part(df, id_col, label_col, vector_col)
    books = train(rows, scratch, parts, entries, rounds, scale)
    if books is None:
        empty = rows.select("id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"))
        return empty.withColumnRenamed("id", id_col), None
    coded = scratch.keep(encoded(rows, books), "coded")
    return with_label_error(coded, scratch).select(F.col("id").alias(id_col), "code", "error", "label_error"), books
