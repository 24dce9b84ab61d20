"""N-gram Jaccard join by PartEnum signatures.

Method. Sets are put into bands of similar size, so that sets within the
threshold are in one band or in neighbouring ones. Two sets of a band pair differ
in at most ``k`` elements. The domain of hashed shingles is cut into ``k + 1`` and
a few more partitions; every choice of one partition's elements is a signature. At
least one partition of two similar sets is the same, so they share a signature.
Which partitions agree is open, and they can all be empty: a set with so many
empty partitions that this may happen also gives signatures of another partition
of the domain, in which the same can only happen to sets that give them too; the
last of these also counts empty partitions as signatures. No pair is lost.

Sets that share signatures, directly or over others, are a family; its least set is
the root, and each set is compared exactly with the root of its family. What a set has
and the root lacks, and the other way round, is its difference. Two sets that are
linked have a distance of at most ``k``, so either both are linked with the root, or
their differences overlap; by how much at least is known from their sizes, and so
is the number of elements (those rarest in the family first) of which two linked
sets must share one. Sets that share one are compared exactly by their differences:
first neighbours in some orders, in turns that join the classes known so far, then
all that still are in different classes. So a group of thousands of near copies gives
about as many comparisons as it has links to prove, not one for every two copies of one text.

Copies have one set and one node; a task sends a set's signatures once, so that
even a third of all rows being copies gives a row for each task and signature.
Null and empty texts have no set and are linked with nothing; texts of fewer words
than a shingle have one element, the whole sequence; repeated rows are copies; an
empty table gives an empty table; other columns are ignored. Shingles are compared as
64-bit hashes, and equal sets are known by a 64-bit sum of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .components import components
from .storage import Scratch, small_batches

#: Partitions of the domain that are tried before empty partitions count.
TRIES = 3
#: Rows of a table of node numbers that may be broadcast.
BROADCAST_ROWS = 2_000_000


class PartEnum:
    """Signatures of sorted arrays of 64-bit hashes for ``100 * |A and B| >= percent * |A or B|``."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("the threshold must be from 50 to 100 percent")
        self.percent = percent
        self.bands: list[tuple[int, int]] = [(1, 100 // percent)]

    def band(self, size: int) -> int:
        while self.bands[-1][1] < size:
            low = self.bands[-1][1] + 1
            self.bands.append((low, max(low, 100 * low // self.percent)))
        return next(i for i in range(len(self.bands) - 1, -1, -1) if self.bands[i][0] <= size)

    def differ(self, band: int) -> int:
        """The most elements in which similar sets of this band and the one below can differ."""
        while len(self.bands) <= band:
            self.band(self.bands[-1][1] + 1)
        return 2 * self.bands[band][1] * (100 - self.percent) // (100 + self.percent)

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures, and for each twice the number of signatures of its band that a linked set must share, plus one in the upper band."""
        if not len(s):
            return np.zeros(0, np.uint64), np.zeros(0, np.int32)
        parts = self.parts(s)
        return np.concatenate([x for x, _ in parts]), np.repeat(np.array([n for _, n in parts], np.int32), [len(x) for x, _ in parts])

    def parts(self, s: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """:meth:`signatures` of a set that is not empty, by how many must be shared."""
        band, sums = self.band(len(s)), {}
        return [(x, 2 * need + up) for up in (0, 1) for x, need in self.of_band(s, band + up, sums)]

    def of_band(self, s: np.ndarray, band: int, sums: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, int]]:
        """Signatures of one band; ``sums`` holds, for each partition of the domain, the order of the elements and their running sums."""
        k = self.differ(band)
        parts = k + 1 + (1 + min(k, 8) // 4 + k // 12 if k else 0)
        edges = (np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts)) if parts > 1 else np.zeros(0, np.uint64)
        out = []
        for turn in range(TRIES):
            if turn not in sums:
                own = s if not turn else np.sort(shingles.mix(s + np.uint64(turn)))
                sums[turn] = own, np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles.mix(own ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)])
            own, total = sums[turn]
            cut = np.concatenate([[0], np.searchsorted(own, edges), [len(own)]])
            each = shingles.mix(total[cut[1:]] - total[cut[:-1]] + shingles.mix(np.arange(parts, dtype=np.uint64) + np.uint64((band << 40) + (turn << 32) + 1)))
            full = cut[1:] > cut[:-1]
            spare = int(full.sum()) - k  # partitions that a linked set shares and that are not empty
            if spare > 0:
                return [*out, (each[full], 1 if out else spare)]
            out.append((each if turn == TRIES - 1 else each[full], 1))
        return out


def _arrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text"))


def _node(s: np.ndarray) -> int:
    """One number for a set; equal sets have equal numbers. Positive, so that signs do not matter in joins."""
    return int(shingles.mix(np.array([np.sum(shingles.mix(s), dtype=np.uint64) + np.uint64(len(s))]))[0] >> np.uint64(1))


#: Signatures of one number of needed ones.
PARTS = "array<struct<need: int, sigs: array<long>>>"


def described(df: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_shingles long, node long, parts)``: the node is null for texts without words; a task gives the signatures of equal sets once.

    Texts are cut into shingles once: sets and signatures come from one pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        method, seen = PartEnum(percent), set()
        for b in batches:
            found = shingles.sets(b.column(1).to_pylist(), words)
            nodes = [_node(s) if len(s) else None for s in found]
            count, needs, sigs = [0], [], []
            for s, node in zip(found, nodes, strict=True):
                if node is not None and node not in seen:
                    seen.add(node)
                    for sig, need in method.parts(s):
                        sigs.append(sig.view(np.int64))
                        needs.append(need)
                count.append(len(needs))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sigs])]), pa.int32())
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *sigs]))
            parts = pa.StructArray.from_arrays([pa.array(needs, pa.int32()), pa.ListArray.from_arrays(ends, values)], ["need", "sigs"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(count, pa.int32()), parts)], ["id", "n_shingles", "node", "parts"])

    return _arrow(df, id_col, text_col).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, n_shingles long, node long, parts {PARTS}")


def _sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles.mix(s) & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def element_sets(rows: DataFrame, words: int) -> DataFrame:
    """``(root long, node long, elements array<long>, sketch array<long>)`` of rows ``(root, node, text binary)``; rows of other sets than their node's are left out.

    The sketch holds, for each of 1024 classes of elements, whether their number is
    odd: two sets differ in at least as many elements as their sketches in bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shingles.sets(b.column(2).to_pylist(), words)
            keep = [i for i, (s, node) in enumerate(zip(found, b.column(1).to_pylist(), strict=True)) if len(s) and _node(s) == node]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())), pa.array([found[i].view(np.int64) for i in keep], pa.list_(pa.int64())), pa.array([_sketch(found[i]) for i in keep], pa.list_(pa.int64()))], ["root", "node", "elements", "sketch"])

    return rows.mapInArrow(run, "root long, node long, elements array<long>, sketch array<long>")


def _linked(common: Column, size_a: str, size_b: str, percent: int) -> Column:
    return (100 + percent) * common >= percent * (F.col(size_a) + F.col(size_b))


def differences(known: DataFrame, percent: int) -> DataFrame:
    """``(root, own, node, n, near, sketch, plus, minus)`` for each set but the roots: its size, whether it is linked with the root, what it has more and less.

    A set that differs from the root in more than it has elements is described by
    itself (``own``: all of it is ``plus``). Linked sets differ little in what
    they differ from the root; so in a middle range, wide enough that two linked
    sets always have a description of one kind, sets have both.
    """
    base = known.where("node = root").select("root", F.col("elements").alias("root_elements"))
    both = known.where("node <> root").join(base, "root")
    both = both.select("root", "node", F.size("elements").alias("n"), F.size("root_elements").alias("n_root"), "elements", "root_elements", "sketch", F.array_except("elements", "root_elements").alias("plus"))
    common = F.col("n") - F.size("plus")
    ratio = (F.col("n") + F.col("n_root") - 2 * common) / F.col("n")
    least = max(0.0, percent / 100 - (100 - percent) / percent - 0.01)
    near = _linked(common, "n", "n_root", percent)
    of_root = F.when(ratio <= 1, F.struct(F.lit(False).alias("own"), "plus", F.array_except("root_elements", "elements").alias("minus")))
    of_own = F.when((ratio >= least) & ~near, F.struct(F.lit(True).alias("own"), F.col("elements").alias("plus"), F.array().cast("array<long>").alias("minus")))
    out = both.select("root", "node", "n", near.alias("near"), "sketch", F.explode(F.array_compact(F.array(of_root, of_own))).alias("d"))
    return out.select("root", "d.own", "node", "n", "near", "sketch", "d.plus", "d.minus")


#: Numbers of 64 bits of a whole sketch, and of a folded one.
WHOLE, FOLDED = 16, 4
#: Orders in which sets with much the same differences stand together.
ORDERS = 16
#: An element of fewer sets of a family than this counts as one of none.
COMMON = 32
#: Turns in which classes are joined before all pairs are, and how many rows a set is compared with in one.
TURNS, SPAN = 3, 64


def _small(df: DataFrame) -> DataFrame:
    """``df``, a kept table, marked for a broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def elements(apart: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``(root, own, node, n, near, d, s0.., place, element, least)``: a row for each element of which two linked sets, not both near the root, must share one.

    Any order of elements that a whole family keeps will do; the rarest come first, so
    that an element that most of a family has is used by few sets; ``place`` counts from 0 in
    this order. ``least`` is the set's least element in one of some orders, which the
    element picks. The work for a set is in proportion to its difference.
    """
    each = apart.select("root", "own", "node", F.explode(F.concat("plus", "minus")).alias("element"))
    common = scratch.keep(each.groupBy("root", "own", "element").count().where(F.col("count") >= COMMON), "common")
    leasts = [F.min(F.xxhash64("element", F.lit(k))).alias(f"l{k}") for k in range(ORDERS)]
    ranked = each.join(_small(common), ["root", "own", "element"], "left").groupBy("node", "own").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "element"))).alias("ranked"), *leasts)
    d = F.size("ranked")
    far = F.floor(F.col("n") * (100 - percent) / percent) + 1
    near = F.floor(d * (100 / (100 + percent)) + 0.5) + 1
    few = F.least(d, F.when(F.col("near"), near).otherwise(far)).cast("int")
    folded = [F.expr(" ^ ".join(f"sketch[{i}]" for i in range(k, WHOLE, FOLDED))).alias(f"s{k}") for k in range(FOLDED)]
    rows = apart.select("root", "own", "node", "n", "near", *folded).join(ranked, ["node", "own"])
    rows = rows.select("root", "own", "node", "n", "near", d.alias("d"), *[f"s{k}" for k in range(FOLDED)], F.array(*[f"l{k}" for k in range(ORDERS)]).alias("leasts"), F.posexplode(F.slice("ranked.element", 1, few)).alias("place", "element"))
    return scratch.keep(rows.withColumn("least", F.element_at("leasts", (F.pmod("element", F.lit(ORDERS)) + 1).cast("int"))).drop("leasts"), "elements")


def _fits(a, b, percent: int) -> Column:
    """``a`` and ``b`` give a field's column: not both near the root, and sizes that links can have."""
    return ~(a("near") & b("near")) & (100 * F.least(a("n"), b("n")) >= percent * F.greatest(a("n"), b("n")))


def _few_bits(bits: Column, a, b, percent: int) -> Column:
    """Whether the sketches differ in no more bits than linked sets in elements."""
    return (100 + percent) * bits <= (100 - percent) * (a("n") + b("n"))


def neighbouring(rows: DataFrame, percent: int) -> DataFrame:
    """``(a, b, own)``: pairs that may be linked, of neighbours among the sets that share one of :func:`elements`.

    Neighbours are looked for in two orders: by distance from the root, and by
    ``least``. Rows are dealt out by ranges of element and order, so that an element
    of very many sets is cut up too; a pair on both sides of a cut is left to
    :func:`overlapping`, as all that these orders do not bring together.
    """

    def adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            now = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
            if last is not None:
                now = {c: np.concatenate([last[c], x]) for c, x in now.items()}
            last = {c: x[-1:] for c, x in now.items()}
            one, two = ({c: x[at] for c, x in now.items()} for at in (slice(None, -1), slice(1, None)))
            keep = (one["root"] == two["root"]) & (one["own"] == two["own"]) & (one["element"] == two["element"]) & (one["node"] != two["node"]) & ~(one["near"] & two["near"])
            n, m = one["n"].astype(np.int64), two["n"].astype(np.int64)
            keep &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            bits = sum(np.bitwise_count(one[f"s{k}"] ^ two[f"s{k}"]).astype(np.int64) for k in range(FOLDED))
            keep &= (100 + percent) * bits <= (100 - percent) * (n + m)
            x, y = one["node"][keep], two["node"][keep]
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64()), "own": pa.array(one["own"][keep], pa.bool_())})

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for order in ("d", "least"):
        key = ["root", "own", "element", order, "node"]
        dealt = rows.select(*key, "n", "near", *[f"s{k}" for k in range(FOLDED)]).repartitionByRange(parts, *key).sortWithinPartitions(*key)
        found.append(dealt.mapInArrow(adjacent, "a long, b long, own boolean"))
    return found[0].unionByName(found[1]).distinct()


def mixed(rows: DataFrame, labels: DataFrame, apart: DataFrame) -> DataFrame:
    """Rows of :func:`elements` that share their element with a set of another label, with labels and whole sketches."""
    group = ["root", "own", "element"]
    rows = rows.select(*group, "node", "n", "near", "d", "place").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = rows.groupBy(*group).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select(*group)
    return rows.join(several, group).join(apart.select("node", "own", "sketch"), ["node", "own"])


def across(some: DataFrame, percent: int, turn: int) -> DataFrame:
    """``(a, b, own, one, two)``: pairs of :func:`mixed` rows that may link the labels ``one`` and ``two``.

    Each row is compared with the ``SPAN`` before it in an order of labels that
    differs by ``turn``; of the pairs of one element those are given, the likeliest
    first, that join labels not yet joined by others. What this passes over is left
    to :func:`overlapping`.
    """

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            now = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("root", "own", "element", "node", "n", "near", "label")}
            now["n"], now["sketch"] = now["n"].astype(np.int64), b.column("sketch").flatten().to_numpy().reshape(-1, WHOLE)
            old = 0 if last is None else len(last["node"])
            if old:
                now = {c: np.concatenate([last[c], x]) for c, x in now.items()}
            last = {c: x[-SPAN:] for c, x in now.items()}
            new = np.ones(len(now["node"]), bool)
            for c in ("root", "own", "element"):
                new[1:] &= now[c][1:] == now[c][:-1]
            run = np.cumsum(~new)
            ends = []
            for step in range(1, min(SPAN, len(run) - 1) + 1):
                two = np.arange(max(step, old), len(run))
                two = two[run[two] == run[two - step]]
                if not len(two):
                    break
                n, m = now["n"][two], now["n"][two - step]
                keep = (now["label"][two] != now["label"][two - step]) & ~(now["near"][two] & now["near"][two - step]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                two = two[keep]
                spare = (100 - percent) * (n + m)[keep] - (100 + percent) * np.bitwise_count(now["sketch"][two] ^ now["sketch"][two - step]).sum(1, dtype=np.int64)
                ends.append(np.stack([spare, two - step, two])[:, spare >= 0])
            pairs = np.concatenate([np.zeros((3, 0), np.int64), *ends], 1)
            above: dict[tuple[int, int], tuple[int, int]] = {}

            def top(x: tuple[int, int], above=above) -> tuple[int, int]:
                while x in above:
                    x = above[x]
                return x

            kept = []
            for k in np.argsort(-pairs[0], kind="stable"):
                i, j = pairs[1:, k]
                x, y = top((run[i], now["label"][i])), top((run[j], now["label"][j]))
                if x != y:
                    above[max(x, y)] = min(x, y)
                    kept.append((i, j))
            i, j = np.array(kept, np.int64).reshape(-1, 2).T
            x, y = now["node"][i], now["node"][j]
            swapped = x > y
            yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y), "own": now["own"][i].astype(bool), "one": np.where(swapped, now["label"][j], now["label"][i]), "two": np.where(swapped, now["label"][i], now["label"][j])})

    parts = int(some.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["root", "own", "element", "order", "label", "node"]
    dealt = some.withColumn("order", F.xxhash64("label", F.lit(turn))).select(*key, "n", "near", "sketch").repartitionByRange(parts, *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(likely, "a long, b long, own boolean, one long, two long").distinct()


def joined(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``labels`` after the labels of ``links`` have become one."""
    above = scratch.keep(components(links, scratch, f"{name}-above").select(F.col("node").alias("label"), F.col("label").alias("to")), f"{name}-to")
    every = labels.unionByName(above.select(F.col("label").alias("node"), "label")).groupBy("node").agg(F.min("label").alias("label"))
    return scratch.keep(every.join(_small(above), "label", "left").select("node", F.coalesce("to", "label").alias("label")), name)


def overlapping(some: DataFrame, percent: int) -> DataFrame:
    """``(a, b, own, one, two)``: all pairs of :func:`mixed` rows that share an element, have different labels and may be linked.

    No pair is lost by looking at places: from the first element on that two linked
    sets share, both still have as many as they must share.
    """
    group = ["root", "own", "element"]
    one, two = (some.select(*group, *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n", "near", "d", "place", "sketch")]) for x in ("a", "b"))
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    bits = F.expr(" + ".join(f"bit_count(sketch_a[{i}] ^ sketch_b[{i}])" for i in range(WHOLE)))
    left = F.least(a("d") - a("place"), b("d") - b("place"))
    enough = (100 + percent) * (a("d") + b("d") - 2 * left) <= (100 - percent) * (a("n") + b("n"))
    fit = (a("node") < b("node")) & (a("label") != b("label")) & enough & _fits(a, b, percent) & _few_bits(bits, a, b, percent)
    return one.join(two, group).where(fit).select(a("node").alias("a"), b("node").alias("b"), "own", a("label").alias("one"), b("label").alias("two")).distinct()


def _verified(pairs: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, by their differences from the root: all columns but ``own``."""
    left, right = (apart.select(F.col("node").alias(x), "own", *[F.col(c).alias(f"{c}_{x}") for c in ("n", "plus", "minus")]) for x in ("a", "b"))
    joined = pairs.join(left, ["a", "own"]).join(right, ["b", "own"])
    same = F.size(F.array_intersect("plus_a", "plus_b")) + F.size(F.array_intersect("minus_a", "minus_b"))
    apart_by = F.size("plus_a") + F.size("minus_a") + F.size("plus_b") + F.size("minus_b") - 2 * same
    return joined.where(_linked((F.col("n_a") + F.col("n_b") - apart_by) / 2, "n_a", "n_b", percent)).select(*[c for c in pairs.columns if c != "own"])


def classes(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``df``: ``(id_col, n_shingles long, component_id)``.

    ``component_id`` is the smallest id reachable by links, the row's own included.
    """
    small_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "jaccard")
    passed = scratch.keep(described(df, words, percent, id_col, text_col), "described")
    rows = scratch.keep(passed.select("id", "n_shingles", "node"), "members")

    by_sig = Window.partitionBy("sig")
    signatures = passed.select("node", F.explode("parts").alias("part")).select("node", "part.need", F.explode("part.sigs").alias("sig"))
    shared = signatures.withColumns({"least": F.min("node").over(by_sig), "most": F.max("node").over(by_sig)}).where("least < most").select("sig", "node", "need").distinct()
    shared = scratch.keep(shared, "shared")
    scratch.drop("described")
    enough = shared.groupBy("node", "need").count().where("count >= need DIV 2").select("node", "need")
    shared = shared.join(enough, ["node", "need"], "left_semi").select("node", F.min("node").over(by_sig).alias("least")).where("node <> least").distinct()
    shared = shared.withColumn("first", F.min("least").over(Window.partitionBy("node")))
    # One link a set, to the first of the least sets it shares a signature with, and those to each other.
    family = shared.select("node", F.col("first").alias("to")).unionByName(shared.where("least <> first").select(F.col("least").alias("node"), F.col("first").alias("to"))).distinct()
    roots = scratch.keep(components(family, scratch, "families").select("node", F.col("label").alias("root")), "roots")
    known = scratch.keep(element_sets(_rows_of(df, rows, roots, id_col, text_col), words).dropDuplicates(["node"]), "sets")
    apart = scratch.keep(differences(known, percent), "differences")
    scratch.drop("sets")
    links = apart.where("near").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct()
    some = elements(apart, percent, scratch)
    links = scratch.keep(links.unionByName(_verified(scratch.keep(neighbouring(some, percent), "neighbouring"), apart, percent)), "links")
    labels = scratch.keep(components(links, scratch, "first"), "labels")
    for turn in range(TURNS + 1):
        several = scratch.keep(mixed(some, labels, apart), f"mixed-{turn}")
        pairs = across(several, percent, turn) if turn < TURNS else overlapping(several, percent)
        more = scratch.keep(_verified(scratch.keep(pairs, f"pairs-{turn}"), apart, percent).select("one", "two").distinct(), f"links-{turn}")
        if not more.isEmpty():
            labels = joined(labels, more, scratch, f"labels-{turn}")
        scratch.drop(f"mixed-{turn}")

    placed = rows.join(labels, "node", "left").select("id", "n_shingles", F.coalesce("label", "node").alias("label"))
    placed = scratch.keep(placed, "placed")
    least = scratch.keep(placed.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("component")), "least")
    return placed.join(_small(least), "label", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def _rows_of(df: DataFrame, rows: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(root, node, text)`` of one row of ``df`` for each node (more where an id repeats)."""
    ids = rows.join(roots, "node").groupBy("node", "root").agg(F.min("id").alias("id"))
    if roots.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return _arrow(df, id_col, text_col).join(ids, "id").select("root", "node", "text")
