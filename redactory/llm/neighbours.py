"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Method. Rows of one vector are one entry. K-means over a bounded sample gives coarse
centroids and, over the residuals, a codebook for each part of the vector. Every
entry is indexed: its list and its codes. A query looks at the lists whose centroids
give the largest inner products; the codes score their entries; the best of each
query are ranked again by the exact inner product of the original vectors.

How many lists and how long a shortlist is measured, not fixed: for some of the
queries the true neighbours are found by comparing them with every vector, and both
numbers are the least that keep the share ``recall`` of them, counted by rows and by
different vectors (``probes``, ``least_rows`` and ``shortlist`` are lower bounds). Where lists say little about
nearness, as with vectors of no direction, most lists are looked at.

Lists are cut by a hash into cells of about ``block`` entries, a row each, so that a large
list is many rows. Queries are packed into rows of up to ``query_block``, in order of
their first list, and joined with the cells of the lists that one of them looks at: cells
that no query wants are not moved. A pack meets its cells by parts of the index
of up to ``part`` cells, keeping a shortlist a query; one pack and one cell are in memory.

Nearness is the inner product in double precision; ties go to the smaller id.
Defined results: vectors that are null, zero, or of other than the usual length, or
that hold null or non-finite components take no part; of rows with one id the
least vector counts; a query is not its own neighbour; with fewer candidates than
asked for all are returned; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, small_batches


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id long, v array<double>)``: the rows that take part, one an id."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).groupBy("id").agg(F.min("v").alias("v"))


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmax(x[at : at + 4096] @ c.T - half, 1) for at in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Index:
    """Coarse centroids (lists x d) and codebooks (parts x codes x d / parts)."""

    coarse: np.ndarray
    books: np.ndarray

    @classmethod
    def train(cls, x: np.ndarray, lists: int, parts: int, seed: int = 3) -> Index:
        rng = np.random.default_rng(seed)
        coarse = k_means(x, lists, 12, rng)
        rest = x - coarse[nearest(x, coarse)]
        parts = max(p for p in range(1, parts + 1) if x.shape[1] % p == 0)
        pieces = np.split(rest, parts, 1)
        k = min(256, len(x))
        return cls(coarse, np.stack([k_means(p, k, 10, rng) for p in pieces]))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(x, self.coarse)
        rest = np.split(x - self.coarse[lists], len(self.books), 1)
        return lists, np.stack([nearest(p, b) for p, b in zip(rest, self.books, strict=True)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Queries x parts x codes: each part of a query against each code."""
        return np.einsum("qpd,pcd->qpc", q.reshape(len(q), len(self.books), -1), self.books)

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that stand for entries: their inner products are the scores of the codes."""
        return self.coarse[lists] + np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], 1)

    def probed(self, q: np.ndarray, sizes: np.ndarray, lists: int, rows: int) -> np.ndarray:
        """Queries x lists: whether the query looks at the list."""
        order = np.argsort(-(q @ self.coarse.T), 1, kind="stable")
        before = np.cumsum(sizes[order], 1) - sizes[order]
        wanted = (np.arange(order.shape[1]) < lists) | (before < min(rows, sizes.sum()))
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, wanted, 1)
        return out


def best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` of the largest scores; ties go to the smaller id, minus infinity is no score."""
    fine = np.flatnonzero(scores > -np.inf)
    if len(fine) > n:
        least = np.partition(scores[fine], len(fine) - n)[len(fine) - n]
        fine = fine[scores[fine] >= least]
        fine = fine[np.lexsort((ids[fine], -scores[fine]))[:n]]
    return ids[fine], scores[fine]


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(n, -1)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def measure(entries: DataFrame, placed: DataFrame, index: Index, who: DataFrame, k: int, share: float, queries: int) -> tuple[int, int]:
    """How many lists, and how long a shortlist, keep ``share`` of the ``k`` true neighbours.

    Queries are drawn as rows, so that a vector which many queries hold counts as often;
    a neighbour counts as often as its copies are in an answer. The share is kept by that
    count, and where each pair of different vectors counts once. A query's own copies are always found.
    """
    drawn = who.orderBy(F.xxhash64("query_id"), "query_id").limit(queries).groupBy("vec").agg(F.count("*").alias("rows"))
    some = F.broadcast(drawn).join(entries, "vec").select("vec", "v", "rows").toPandas()
    own, q, rows = some["vec"].to_numpy(np.int64), np.array(some["v"].to_list(), np.float64), some["rows"].to_numpy(np.int64)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = [np.zeros(0, np.int64)] * len(q), [np.zeros(0)] * len(q)
        for b in batches:
            if b.num_rows:
                of = b.column(0).to_numpy()
                for i, s in enumerate(q @ _vectors(b.column(1), b.num_rows).T):
                    new = best(of, s, k + 1)
                    ids[i], scores[i] = best(np.concatenate([ids[i], new[0]]), np.concatenate([scores[i], new[1]]), k + 1)
        at = np.repeat(np.arange(len(q)), [len(i) for i in ids])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["at", "vec", "near"])

    order = Window.partitionBy("at").orderBy(F.desc("near"), "vec")
    near = entries.select("vec", "v").mapInArrow(exact, "at int, vec long, near double").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    true = F.broadcast(F.broadcast(near.select("at", "vec", "place")).join(placed, "vec")).join(entries.select("vec", F.size("ids").alias("copies")), "vec")
    true = true.toPandas().sort_values(["at", "place"])  # k + 1 rows a measured query
    itself = own[true["at"]] == true["vec"].to_numpy()
    true["copies"] -= itself
    before = true.groupby("at")["copies"].cumsum() - true["copies"]
    true["times"] = np.minimum(true["copies"], k - before)
    true = true[(true["times"] > 0) & ~itself]
    if not len(true):
        return 1, 1
    at, lists = true["at"].to_numpy(), true["list"].to_numpy()
    place = np.argsort(np.argsort(-(q @ index.coarse.T), 1, kind="stable"), 1)[at, lists] + 1
    codes = np.frombuffer(b"".join(true["codes"]), np.uint8).reshape(len(true), -1)
    terms = q[at] * index.decoded(lists, codes)
    least = terms.sum(1) - 1e-12 * np.abs(terms).sum(1)  # sums differ in their last bits

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(at), np.int64)
        for b in batches:
            if b.num_rows:
                c = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                s = np.sort(q @ index.decoded(b.column(1).to_numpy(), c).T, 1)
                for i in range(len(q)):
                    n[at == i] += b.num_rows - np.searchsorted(s[i], least[at == i])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], ["pair", "n"])

    ranks = placed.select("vec", "list", "codes").mapInArrow(above, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toPandas()["n"]
    times = true["times"].to_numpy() * rows[at]
    enough = [max(reached(x, w, share) for w in (times, np.ones(len(x), np.int64))) for x in (place, ranks.to_numpy())]
    return enough[0], enough[1]


def reached(x: np.ndarray, weight: np.ndarray, share: float) -> int:
    """The least ``x`` up to which ``share`` of all weight lies."""
    order = np.argsort(x, kind="stable")
    kept = np.cumsum(weight[order])
    return int(x[order][min(len(x) - 1, int(np.searchsorted(kept, share * kept[-1])))])


def search(
    df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", train_rows: int = 20_000, lists: int | None = None,
    probes: int = 24, parts: int = 16, shortlist: int = 100, least_rows: int = 2000, block: int = 1024, part: int = 1024, query_block: int = 512, recall: float = 0.98, measured: int = 256,
) -> DataFrame:
    """``(query_id, rank, id_col, score)``: for each row of ``df`` with ``queries`` true its ``k`` nearest others.

    ``queries`` is a condition on the column ``id``. ``lists`` defaults to the root
    of the number of vectors, up to 4096. The index is trained on about ``train_rows``
    vectors picked by a hash of the id; ``measured`` queries set what ``recall`` needs.
    """
    spark = df.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "neighbours")
    rows = scratch.keep(valid(df, id_col, vector_col), "rows")
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, id long, score double"
    if usual is None:
        return spark.createDataFrame([], empty).withColumnRenamed("id", id_col)
    rows = rows.where(F.size("v") == usual.d)
    # An entry a distinct vector; its k + 1 least ids are all that an answer can hold.
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = scratch.keep(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("vec"), "v", "ids"), "entries")
    n = entries.count()
    sample = entries if n <= train_rows else entries.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(train_rows / n * (1 << 30)))
    x = np.array(sample.orderBy("vec").select("v").toPandas()["v"].to_list(), np.float64)
    index = Index.train(x, lists or int(min(4096, max(1, n**0.5))), parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, codes = index.place(_vectors(b.column(1), b.num_rows))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec", "list", "codes"])

    placed = scratch.keep(entries.select("vec", "v").mapInArrow(place, "vec long, list int, codes binary"), "index")
    sizes = np.zeros(len(index.coarse), np.int64)
    for r in placed.groupBy("list").count().collect():
        sizes[r.list] = r["count"]

    who = scratch.keep(rows.where(queries).select(F.col("id").alias("query_id"), "v").join(entries.select("vec", "v"), "v").select("query_id", "vec"), "who")
    asked = scratch.keep(who.select("vec").distinct().join(entries, "vec").select("vec", "v"), "asked")
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], empty).withColumnRenamed("id", id_col)
    wanted, length = measure(entries, placed, index, who, k, 1 - (1 - recall) / 2, measured)
    wanted, length = max(wanted, probes), max(length, shortlist)

    def first_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((_vectors(b.column(1), b.num_rows) @ index.coarse.T).argmax(1), pa.int32())], ["vec", "v", "list"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of a task as rows of up to ``query_block`` of them, named by the first."""
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            vecs = np.concatenate([h[0] for h in held])
            return pa.RecordBatch.from_arrays([pa.array(vecs[:1]), pa.array([vecs.tobytes()], pa.binary()), pa.array([np.concatenate([h[1] for h in held]).tobytes()], pa.binary())], ["pack", "vecs", "q"])

        for b in batches:
            for at in range(0, b.num_rows, query_block):
                rows = b.slice(at, query_block)
                if n and n + rows.num_rows > query_block:
                    yield packed()
                    held, n = [], 0
                held.append((rows.column(0).to_numpy(), _vectors(rows.column(1), rows.num_rows)))
                n += rows.num_rows
        if n:
            yield packed()

    def looks_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists that a query of a pack looks at."""
        for b in batches:
            for name, vecs, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                some = np.flatnonzero(index.probed(np.frombuffer(q).reshape(len(vecs) // 8, -1), sizes, wanted, least_rows).any(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), name)), pa.array(some, pa.int32())], ["pack", "list"])

    # A row a list, of which there are at most ``lists``: how many cells it has, and how many are before it.
    count = -(-sizes // block)
    of_lists = F.broadcast(spark.createDataFrame([(i, int(c), int(at)) for i, (c, at) in enumerate(zip(count, np.cumsum(count) - count, strict=True)) if c], "list int, cells long, before long"))
    own = placed.join(of_lists, "list").withColumn("cell", F.col("before") + F.pmod(F.xxhash64("vec"), F.col("cells")))
    cells = scratch.keep(own.groupBy("cell").agg(F.first("list").alias("list"), F.array_sort(F.collect_list(F.struct("vec", "codes"))).alias("held")), "cells")
    turns = asked.mapInArrow(first_list, "vec long, v array<double>, list int").repartitionByRange(max(1, -(-n_asked // query_block)), "list", "vec").sortWithinPartitions("list", "vec")
    turns = scratch.keep(turns.select("vec", "v").mapInArrow(pack, "pack long, vecs binary, q binary"), "turns")
    asks = turns.mapInArrow(looks_at, "pack long, list int").join(of_lists, "list").select("pack", F.explode(F.sequence("before", F.col("before") + F.col("cells") - 1)).alias("cell"))
    asks = scratch.keep(asks.withColumn("part", F.floor(F.col("cell") / part).cast("long")), "asks")
    nothing = (F.lit(None).cast(t).alias(c) for c, t in (("cell", "long"), ("list", "int"), ("held", "array<struct<vec:bigint,codes:binary>>")))
    heads = asks.select("pack", "part").distinct().join(turns, "pack").select("pack", "part", *nothing, "vecs", "q")
    met = asks.join(cells, "cell").select("pack", "part", "cell", "list", "held", F.lit(None).cast("binary").alias("vecs"), F.lit(None).cast("binary").alias("q"))
    together = heads.unionByName(met).repartition("pack", "part").sortWithinPartitions("pack", "part", F.col("cell").asc_nulls_first())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking: np.ndarray = np.zeros(0, np.int64)
        top: list[tuple[np.ndarray, np.ndarray]] = []
        q = probed = None

        def ended() -> pa.RecordBatch:
            query = np.repeat(asking, [len(t[0]) for t in top])
            return pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([t[0] for t in top])), pa.array(np.concatenate([t[1] for t in top]))], ["query", "vec", "near"])

        for b in batches:
            for row in range(b.num_rows):
                vecs, q_bytes = b.column("vecs")[row].as_py(), b.column("q")[row].as_py()
                if vecs is not None:  # the head of a pack comes before its cells
                    if top:
                        yield ended()
                    asking, q = np.frombuffer(vecs, np.int64), np.frombuffer(q_bytes).reshape(len(vecs) // 8, -1)
                    probed, top = index.probed(q, sizes, wanted, least_rows), [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
                    continue
                at, held = b.column("list")[row].as_py(), b.column("held")[row].values
                ids, codes = held.field("vec").to_numpy(), np.frombuffer(b"".join(held.field("codes").to_pylist()), np.uint8).reshape(len(held), -1)
                some = np.flatnonzero(probed[:, at])
                near = q[some] @ index.decoded(np.full(len(ids), at), codes).T
                near[asking[some][:, None] == ids] = -np.inf
                full = np.array([top[i][1].min() if len(top[i][1]) == length else -np.inf for i in some])
                for i, s in zip(some[(near >= full[:, None]).any(1)].tolist(), near[(near >= full[:, None]).any(1)], strict=True):
                    new = best(ids, s, length)
                    top[i] = best(np.concatenate([top[i][0], new[0]]), np.concatenate([top[i][1], new[1]]), length)
        if top:
            yield ended()

    scored = scratch.keep(together.select("list", "held", "vecs", "q").mapInArrow(score, "query long, vec long, near double"), "scored")
    short = scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "vec"))).where(F.col("place") <= length)
    pairs = short.select("query", "vec").unionByName(asked.select(F.col("vec").alias("query"), "vec"))  # its copies
    exact = pairs.join(entries, "vec").join(asked.select(F.col("vec").alias("query"), F.col("v").alias("q")), "query").select("query", "vec", "ids", dot("q", "v").alias("score"))
    ranked = exact.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec"))).where(F.col("place") <= k + 1)
    ranked = ranked.select("query", "score", F.explode("ids").alias("id")).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)
    answers = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    found = who.join(answers, who["vec"] == answers["query"]).select("query_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k).alias("found"))
    out = found.select("query_id", F.posexplode("found").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
