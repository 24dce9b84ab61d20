"""Suppressing repeated findings: a window that begins with each finding let through.

A finding passes if its key is new or if at least ``window`` has gone by since the last that
passed; one that is suppressed does not move the window. A window of 0 lets all pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.folders import scratch
from .order import placed

#: Windows of a chunk of a hot key, and the most keys that can be hot.
CHUNK, SHARE = 64, 10_000

#: What makes findings the same: neither the row's keys nor channels count.
KEY = ["database", "schema_name", "table_name", "column_name", "rule_id", "value_hash"]


def in_window(df: DataFrame, key: list[str], time: str, window: int, order: list[str] | None = None, hot_rows: int = 1_000_000) -> DataFrame:
    """The rows that pass. ``time`` is a column of whole numbers; ties go by ``order``.

    Rows are dealt out by key, sorted by key and time, and folded in that order with one time carried. Keys of more than
    ``hot_rows`` rows and more than one row in ``SHARE`` (so there are at most ``SHARE`` of them) are divided among tasks by
    :func:`entries`. Rows without a time pass and do not move the window.
    """
    if window <= 0:
        return df
    orders = [f"o{i}" for i in range(len(order or []))]
    rows = df.select(F.struct("*").alias("row"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)]).alias("k"), F.col(time).cast("bigint").alias("at"), *[F.col(c).alias(n) for c, n in zip(order or [], orders, strict=True)])
    sizes = rows.groupBy("k").agg(F.count("at").alias("n"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    least = max(hot_rows, (total or 0) // SHARE)
    if (most or 0) <= least:
        return _folded(rows.withColumns({"chunk": F.lit(None).cast("long"), "entry": F.lit(None).cast("long")}), window, orders)
    path = scratch(df.sparkSession, "hot-keys")
    sizes.where(F.col("n") > least).select("k").write.parquet(path)
    hot = F.broadcast(df.sparkSession.read.schema(sizes.select("k").schema).parquet(path))
    timed = rows.where("at IS NOT NULL").join(hot, "k", "left_semi").withColumn("chunk", F.floor(F.col("at") / (CHUNK * window)))
    first = entries(timed.select("k", "chunk", "at"), window)
    rest = rows.join(hot, "k", "left_anti").unionByName(rows.where("at IS NULL").join(hot, "k", "left_semi"))
    both = timed.join(first, ["k", "chunk"]).select(*rows.columns, "chunk", "entry").unionByName(rest.withColumns({"chunk": F.lit(None).cast("long"), "entry": F.lit(None).cast("long")}))
    return _folded(both, window, orders)


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns (the first does)."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        if pa.types.is_nested(c.type):
            held = c.to_pylist()
            new[1:] |= np.array([x != y for x, y in zip(held[1:], held[:-1], strict=True)], bool)
        else:
            c, n = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c, len(c)
            same = pc.fill_null(pc.equal(c[1:], c[: n - 1]), False).to_numpy(zero_copy_only=False)
            none = pc.is_null(c).to_numpy(zero_copy_only=False)
            new[1:] |= ~(same | (none[1:] & none[:-1]))
    return new


def _first_passing(times: np.ndarray, window: int, last: int | None) -> tuple[list[int], int | None]:
    """Places of the sorted ``times`` that pass after ``last``, and the last of them: one search for each."""
    out, at = [], 0
    while True:
        at = at if last is None else at + int(np.searchsorted(times[at:], last + window))
        if at >= len(times):
            return out, last
        out.append(at)
        last = int(times[at])


def _folded(rows: DataFrame, window: int, orders: list[str]) -> DataFrame:
    """Rows that pass, of ``(row, k, at, chunk, entry, orders...)``: each ``(k, chunk)`` begins at its ``entry``, or with its first row."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            named = pa.table({f"k{i}": c for i, c in enumerate(b.column("k").flatten())} | {"chunk": b.column("chunk")})
            new = _changes([named.column(i).combine_chunks() for i in range(named.num_columns)])
            this = (b.column("k")[0].as_py(), b.column("chunk")[0].as_py())
            new[0] = this != end
            at, keep = b.column("at"), np.zeros(b.num_rows, bool)
            none = pc.is_null(at).to_numpy(zero_copy_only=False)
            times, entry = pc.fill_null(at, 0).to_numpy(), b.column("entry")
            starts = np.flatnonzero(new)
            for lo, hi in zip([0, *starts[starts > 0]], [*starts[starts > 0], b.num_rows], strict=True):
                if new[lo]:
                    last = None if entry[lo].as_py() is None else entry[lo].as_py() - window
                keep[lo:hi] = none[lo:hi]
                there = lo + int(none[lo:hi].sum())  # rows without a time are sorted first
                passing, last = _first_passing(times[there:hi], window, last)
                keep[there + np.array(passing, int)] = True
            end = (b.column("k")[b.num_rows - 1].as_py(), b.column("chunk")[b.num_rows - 1].as_py())
            yield b.filter(pa.array(keep)).select(["row"])

    dealt = rows.repartition("k", "chunk").sortWithinPartitions("k", "chunk", F.asc_nulls_first("at"), *orders)
    return dealt.mapInArrow(fold, rows.select("row").schema).select("row.*")


def entries(times: DataFrame, window: int) -> DataFrame:
    """``(k, chunk, entry)``: the first time that passes in each chunk of a key that has one; ``times`` has ``(k, chunk, at)``.

    Which rows pass is a walk: from a row to the first one a window later. In a chunk, where the walk leaves depends only on where it
    came in, and it comes in less than a window behind the chunk's first row: so each chunk is contracted by itself
    to the few rows where it can come in and the times from which it goes on. Rows between chunks are
    then links of a graph with as many steps as chunks, and those that are reached from a key's first are found by
    doubling: in round ``r`` every link spans ``2 ** r`` chunks, all keys at once.
    """
    spark = times.sparkSession
    folder = scratch(spark, "reached")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def contracted(k: pa.Scalar, chunk: int, parts: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        at = np.concatenate(parts)
        to = np.searchsorted(at, at + window)
        last = np.where(to < len(at), to, np.arange(len(at)))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        n = min(len(at), int(np.searchsorted(at, at[0] + window)) + 1)
        return pa.RecordBatch.from_arrays([pa.array([k] * n, kind), pa.array([chunk] * n, pa.int64()), pa.array(at[:n]), pa.array(at[last[:n]] + window)], ["k", "chunk", "entry", "leaves"])

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, kind = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            kind, at = b.column("k").type, b.column("at").to_numpy()
            new = _changes([*b.column("k").flatten(), b.column("chunk")])
            starts = np.flatnonzero(new)
            for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=True):
                here = (b.column("k")[lo].as_py(), b.column("chunk")[lo].as_py())
                if here != own and parts:
                    yield contracted(*own, parts, kind)
                    parts = []
                own = here
                parts.append(at[lo:hi])
        if parts:
            yield contracted(*own, parts, kind)

    k = times.schema["k"].dataType.simpleString()
    dealt = times.distinct().repartition("k", "chunk").sortWithinPartitions("k", "chunk", "at")
    nodes = keep(dealt.mapInArrow(contract, f"k {k}, chunk long, entry long, leaves long"), "nodes")
    chunks = nodes.select("k", "chunk").distinct().withColumn("to", F.lead("chunk").over(Window.partitionBy("k").orderBy("chunk")))
    out = nodes.join(chunks, ["k", "chunk"]).where("to IS NOT NULL").select("k", F.col("to").alias("chunk"), F.col("leaves").alias("t"), F.lit(0).alias("kind"), F.struct("chunk", "entry").alias("node"))
    there = nodes.select("k", "chunk", F.col("entry").alias("t"), F.lit(1).alias("kind"), F.struct("chunk", "entry").alias("node"))
    after = Window.partitionBy("k", "chunk").orderBy("t", "kind").rowsBetween(0, Window.unboundedFollowing)
    found = out.unionByName(there).withColumn("next", F.first(F.when(F.col("kind") == 1, F.col("node")), ignorenulls=True).over(after))
    links = keep(found.where("kind = 0 AND next IS NOT NULL").select("k", "node", "next"), "links-0")
    reached = keep(nodes.groupBy("k").agg(F.min(F.struct("chunk", "entry")).alias("node")), "reached-0")
    most = chunks.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    for r in range(max(0, most - 1).bit_length()):
        more = reached.join(links, ["k", "node"]).select("k", F.col("next").alias("node"))
        reached = keep(reached.unionByName(more).distinct(), f"reached-{r + 1}")
        double = links.join(links.select("k", F.col("node").alias("next"), F.col("next").alias("far")), ["k", "next"]).select("k", "node", F.col("far").alias("next"))
        links = keep(double, f"links-{r + 1}")
    return reached.select("k", "node.chunk", "node.entry")


def first_only(df: DataFrame, key: list[str], time: str, order: list[str] | None = None) -> DataFrame:
    """A faster mode: the first row of each key alone (rows without a time come first), by one aggregation that begins before the shuffle."""
    first = F.min_by(F.struct("*"), F.struct(F.col(time).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order or [])]))
    return df.groupBy(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)]).agg(first.alias("row")).select("row.*")


def batches(df: DataFrame, size: int, order: list[str], within: list[str] | None = None) -> DataFrame:
    """``df`` with ``batch``: groups of ``size`` rows in order, numbered from 0; without ``within`` over all rows, by ranges."""
    if not within:
        numbered = placed(df, *order, name="batch")
        return numbered.withColumn("batch", F.floor((F.col("batch") - 1) / size))
    window = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(window) - 1) / size))
