"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

Method. The postings ``(term, document, position)`` of every benchmark term in the
documents are stored once as a table of the shared folder; documents get numbers there,
and one more row each, of no term, keeps a document's key and its number of words. Terms
are counted in that table. Every benchmark window (``window`` consecutive words of an item)
is then looked up by intersecting lists, from its rarest term on: the postings of the
rarest, moved back by its place in the window, are candidates; those that the second
rarest confirms at its own place stay; the lists of all other terms, of the documents
left, are intersected at once, and a candidate that every place confirms is an exact
occurrence. A window with a term that no document has is dropped before.

Tables of windows are joined in blocks of at most ``BLOCK`` rows, counted beforehand. Each
step shuffles the lists it needs alone: those of second rarest terms, then those of the
documents left. It does so by document, term and place, which spreads a passage that many
documents share.

Defined results: null and empty texts have no words and no hits; each row is a document of
its own, also if it is repeated or its id is; an item of fewer words than the window is one
window, an item without words none; an empty benchmark hits nothing; other columns are
ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: What stands between words, in raw text: every ASCII character but letters and digits.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands after the last word of a document; no word contains it. Its number as a term.
END, NO_TERM = "\x00", -1
#: Rows of a table of terms or windows, and of numbers of documents, that may be broadcast.
BLOCK, DOCUMENTS = 200_000, 2_000_000


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case; nothing else changes."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def windows_of(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """``(item_id, phrase, n)``: the distinct windows of each item; words are joined by a space."""
    words = benchmark.select(F.col(item_col).alias("item_id"), raw_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    parts = words.select("item_id", "words", F.explode(starts).alias("start")).select("item_id", F.slice("words", F.col("start"), F.lit(window)).alias("part"))
    return parts.select("item_id", lower_ascii(F.array_join("part", " ")).alias("phrase"), F.size("part").alias("n")).distinct()


@dataclass
class Index:
    """The tables of a search: stored postings, the documents, the items of windows, and each window's terms from the rarest on."""

    postings: DataFrame  # term long, doc long, at int
    documents: DataFrame  # doc long, key, n_words int
    items: DataFrame  # window long, item_id
    windows: DataFrame  # window long, n int, terms array<struct<count, term, place>>
    blocks: int

    def block(self, k: int) -> DataFrame:
        return self.windows if self.blocks == 1 else self.windows.where(F.pmod(F.xxhash64("window"), F.lit(self.blocks)) == k)


def index(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str, scratch: Scratch) -> Index:
    """Number windows and terms, store the postings, rank each window's terms by their occurrences in all documents."""
    found = scratch.keep(windows_of(benchmark, window, item_col, item_text_col), "items")
    phrases = scratch.keep(found.select("phrase", "n").distinct().withColumn("window", F.monotonically_increasing_id()), "phrases")
    places = phrases.select("window", "n", F.posexplode(F.split("phrase", " ")).alias("place", "word"))
    terms = scratch.keep(places.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    ends = docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(NO_TERM).cast("long").alias("term"))

    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of")).alias("key"), raw_words(F.col(text_col)).alias("words"))
    each = rows.select("doc", "key", F.posexplode(F.concat("words", F.array(F.lit(END)))).alias("at", "raw")).withColumn("word", lower_ascii(F.col("raw")))
    stored = each.join(small(terms.unionByName(ends), BLOCK), "word").select("term", "doc", "at", F.when(F.col("term") == NO_TERM, F.col("key")).alias("key"))
    stored = scratch.keep(stored, "postings")

    postings = stored.where(F.col("term") != NO_TERM).select("term", "doc", "at")
    counts = scratch.keep(postings.groupBy("term").agg(F.count("*").alias("count")), "counts")
    ranked = places.join(terms, "word").join(counts, "term").groupBy("window", "n").agg(F.sort_array(F.collect_list(F.struct("count", "term", "place"))).alias("terms"))
    windows = scratch.keep(ranked.where(F.size("terms") == F.col("n")), "windows")
    items = found.join(phrases, ["phrase", "n"]).select("window", "item_id")
    documents = stored.where(F.col("term") == NO_TERM).select("doc", "key", F.col("at").alias("n_words"))
    return Index(postings, documents, scratch.keep(items, "items-of-windows"), windows, max(1, -(-windows.count() // BLOCK)))


def _confirmed(candidates: DataFrame, postings: DataFrame, terms: Column) -> DataFrame:
    """The candidates ``(doc, window, start)`` of which each of some of their window's terms stands at its place."""
    asked = candidates.select("doc", "window", "start", F.size(terms).alias("asked"), F.explode(terms).alias("t"))
    asked = asked.select("doc", "window", "start", "asked", F.col("t.term").alias("term"), (F.col("start") + F.col("t.place")).alias("at"))
    agree = postings.join(asked, ["doc", "term", "at"])
    return agree.groupBy("doc", "window", "start", "asked").agg(F.count("*").alias("agree")).where("agree = asked").select("doc", "window", "start")


def occurrences(ix: Index, scratch: Scratch) -> DataFrame:
    """``(doc, window, start, n)`` of every window at every place."""
    out = None
    for k in range(ix.blocks):
        windows = scratch.keep(ix.block(k), f"block-{k}")
        lead = windows.select("window", F.col("terms")[0]["term"].alias("term"), F.col("terms")[0]["place"].alias("place"))
        first = ix.postings.join(F.broadcast(lead), "term").select("doc", "window", (F.col("at") - F.col("place")).alias("start")).where("start >= 0")
        first = scratch.keep(first, f"rarest-{k}")
        known = F.broadcast(windows.select("window", "n", "terms"))
        longer = first.join(known, "window").where("n > 1")
        second = windows.select(F.get("terms", F.lit(1))["term"].alias("term")).where("term IS NOT NULL").distinct()
        of_second = ix.postings.join(F.broadcast(second), "term", "left_semi")
        left = scratch.keep(_confirmed(longer, of_second, F.slice("terms", 2, 1)), f"second-{k}")
        more = left.join(known, "window").where("n > 2")
        of_left = ix.postings.join(small(more.select("doc").distinct(), DOCUMENTS), "doc", "left_semi")
        whole = _confirmed(more, of_left, F.expr("slice(terms, 3, n - 2)"))
        short = first.join(known, "window").where("n = 1").select("doc", "window", "start").unionByName(left.join(known, "window").where("n = 2").select("doc", "window", "start"))
        found = whole.unionByName(short).join(known, "window").select("doc", "window", "start", "n")
        out = found if out is None else out.unionByName(found)
    return scratch.keep(out, "occurrences")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document: ``(id_col, n_words, n_hit, n_items, item_ids array<string>, contaminated, of)``.

    ``n_hit`` counts the words inside any occurrence of a window; ``item_ids`` are
    the items with occurring windows, sorted as strings; ``of`` is the hash of the
    text (``xxhash64``), for joins where ids repeat.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    ix = index(docs, benchmark, window, id_col, text_col, item_col, item_text_col, scratch)
    hits = occurrences(ix, scratch)
    order = Window.partitionBy("doc").orderBy("start")
    covered = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    n_hit = (
        hits.groupBy("doc", "start").agg(F.max("n").alias("n"))
        .withColumn("new", F.col("start") + F.col("n") - F.greatest("start", F.coalesce(covered, F.lit(0))))
        .groupBy("doc").agg(F.sum(F.greatest("new", F.lit(0))).alias("n_hit"))
    )
    items = hits.select("doc", "window").distinct().join(small(ix.items, BLOCK), "window").groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    rows = ix.documents.join(n_hit, "doc", "left").join(items, "doc", "left")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.select(
        F.col("key.id").alias(id_col), F.col("n_words").cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"),
        item_ids.alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.col("key.of").alias("of"),
    )


def proximity(docs: DataFrame, benchmark: DataFrame, within: int = 20, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id_col, item_id, start, end)``: stretches of at most ``within`` words, from one occurrence of a
    window's rarest term on or before it, that hold every distinct term of the window in any order.

    The postings of the other terms less than ``within`` words from the rarest are looked
    at; ``start`` and ``end`` (exclusive) are word positions.
    """
    scratch = Scratch(docs.sparkSession, "proximity")
    ix = index(docs, benchmark, window, id_col, text_col, item_col, item_text_col, scratch)
    out = None
    for k in range(ix.blocks):
        windows = scratch.keep(ix.block(k), f"block-{k}")
        lead = windows.select("window", F.array_distinct("terms.term").alias("terms"), F.col("terms")[0]["term"].alias("term"))
        middle = ix.postings.join(F.broadcast(lead), "term").select("doc", "window", "terms", F.col("at").alias("middle"))
        asked = middle.select("doc", "window", "middle", F.size("terms").alias("asked"), F.explode("terms").alias("term"))
        close = ix.postings.join(asked, ["doc", "term"]).where(F.abs(F.col("at") - F.col("middle")) < within)
        around = close.groupBy("doc", "window", "middle", "asked").agg(F.collect_list(F.struct("at", "term")).alias("near")).where(F.size(F.array_distinct("near.term")) == F.col("asked"))
        held = lambda s: F.size(F.array_distinct(F.transform(F.filter("near", lambda x: (x["at"] >= s) & (x["at"] < s + within)), lambda x: x["term"])))
        starts = F.filter(F.sequence(F.greatest(F.col("middle") - within + 1, F.lit(0)), F.col("middle")), lambda s: held(s) == F.col("asked"))
        found = around.withColumn("starts", starts).where(F.size("starts") > 0).select("doc", "window", F.element_at("starts", -1).alias("start"))
        out = found if out is None else out.unionByName(found)
    spans = out.join(small(ix.items, BLOCK), "window").join(ix.documents, "doc")
    return spans.select(F.col("key.id").alias(id_col), "item_id", "start", F.least(F.col("start") + within, F.col("n_words")).alias("end")).distinct()
