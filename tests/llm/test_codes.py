"""Fill-in-the-middle, vector codes and quality rules: brute force, round trips, held-out labels, and rows that are odd."""

import hashlib
import math
import os
import re
import subprocess
import sys
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redactory.llm import fill_middle, quality_rules, vector_codes

TEXTS = [None, "", "\n", "\n\n\n", "one line", "é\nü ñ\n\n  \nlast", "ends\n", "has <S> inside\nb\n", "< S>\n<\n<P\n>\n", "日本\n" * 300, "a\rb\r\nc d\n\u0085e", "x" * 200_000 + "\n" + "y\n" * 3000]


def by_hand(doc_id, text):
    """The contract, over code points."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_against_code_points(spark, docs_of):
    rows = [(i, t) for i in range(12) for t in TEXTS] + [(None, "a\nb\nc"), (-5, "a\nb\nc"), (3, "one line"), (3, "one line")]
    made = fill_middle.transform(docs_of(rows).withColumn("fim", F.lit(1)).withColumn("a.b", F.lit(2)))
    assert set(made.columns) == {"doc_id", "text", "lang", "sig", "fim", "a.b"}
    got = made.select("doc_id", "text", "fim.*", fill_middle.restore(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs_of([])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("a\né<PSM>"), max_size=60), st.integers(-100, 100))
def test_fill_in_middle_of_any_text(text, doc_id):
    got = fill_middle.transformed(text.encode(), str(doc_id), 7, 100, 50)
    assert (got["n"], got["form"], got["prefix_chars"], got["middle_chars"], got["output"].decode()) == by_hand(doc_id, text)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 2**300))
def test_select_finds_ranked_bits(bits):
    places = [i for i in range(bits.bit_length()) if bits >> i & 1]
    assert [fill_middle.select(bits, k) for k in range(bits.bit_count())] == places


def test_rate_and_seed(spark, docs_of):
    rows = [(i, "a\nb\nc\nd\n") for i in range(2000)]
    half = {r.form: r["count"] for r in fill_middle.transform(docs_of(rows), rate=40, spm=25).groupBy("fim.form").count().collect()}
    assert abs(half["plain"] - 1200) < 80 and abs(half["spm"] - 200) < 50
    other = fill_middle.transform(docs_of(rows[:50]), seed=8).select("fim.output").collect()
    assert other != fill_middle.transform(docs_of(rows[:50])).select("fim.output").collect()


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """``{id: [(code, error, label)]}`` and all entries, with Python's integers."""
    rows = [(i, lab, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, lab, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = len(rows[0][2])
    rows = [r for r in rows if len(r[2]) == dim]
    size, more = divmod(dim, parts)
    edges = [p * size + min(p, more) for p in range(parts + 1)]
    cut = [[tuple(v[a:b]) for a, b in zip(edges, edges[1:])] for _, _, v in rows]  # noqa: B905
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(members[k]) for x in zip(*members[k], strict=True)) if k in members else e for k, e in enumerate(books[p])]
    out = []
    for (i, lab, _), c in zip(rows, cut, strict=True):
        best = [near(x, b) for x, b in zip(c, books, strict=True)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
    sums = Counter()
    for _, _, e, lab in out:
        sums[lab] += e
    fits = lambda e: e if e < 2**63 else None
    return Counter((i, code, fits(e), fits(sums[lab])) for i, code, e, lab in out), ",".join(str(x) for b in books for e in b for x in e)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("v", F.lit("x")).repartition(3)


@pytest.mark.parametrize(("scale", "dim", "entries"), [(0.2, 8, 16), (3e4, 6, 5), (1e200, 3, 4), (0.2, 5, 256)])
def test_vector_codes_against_brute_force(spark, scale, dim, entries):
    """In integers of 32 bits, of 64 bits, and without bounds; lengths that four does not divide."""
    rng = np.random.default_rng(dim)
    rows = [(i, None if i % 7 == 0 else i % 3, [float(x) for x in rng.normal(size=dim) * scale]) for i in range(90)]
    rows += [(200 + i, 1, rows[5][2]) for i in range(40)] + [(5, 2, rows[6][2]), (5, 2, rows[6][2]), (None, 1, rows[7][2])]
    odd = [(300, 1, None), (301, 1, []), (302, 1, [None] * dim), (303, 1, [float("nan")] * dim), (304, 1, [float("-inf")] * dim), (305, 1, [0.5] * (dim + 1)), (306, 1, [0.0] * dim)]
    got, books = vector_codes.compress(vectors_of(spark, rows + odd), entries=entries)
    want, said = codes_by_hand(rows + odd, entries=entries)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()) == want
    assert books.sha256() == hashlib.sha256(said.encode()).hexdigest()
    assert books.numbers.kind == {0.2: "i4", 3e4: "i8", 1e200: "O"}[scale]


def test_vector_codes_of_many_labels_and_none(spark):
    """Rare labels are joined by a shuffle, frequent ones are broadcast."""
    rows = [(i, i if i % 2 else None, [float(i % 11), float(i % 5), 1.0, -0.3]) for i in range(3000)]
    got, _ = vector_codes.compress(vectors_of(spark, rows), entries=3, rounds=1)
    held = got.collect()
    none = sum(r.error for r in held if r.vec_id % 2 == 0)
    assert len(held) == 3000 and all(r.label_error == (r.error if r.vec_id % 2 else none) for r in held)
    empty, books = vector_codes.compress(vectors_of(spark, rows[:2]).where("false"))
    assert books is None and empty.count() == 0 and empty.columns == got.columns


def test_decoded_vectors_are_as_far_as_said(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    got, books = vector_codes.compress(vectors_of(spark, [(i, 0, [float(c) for c in v]) for i, v in enumerate(x)]))
    for r in got.collect():
        near = books.decode(np.frombuffer(bytes.fromhex(r.code), np.uint8)[None])[0] * 1024
        assert r.error == int(((np.floor(x[r.vec_id] * 1024) - near) ** 2).sum())


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\té# "), max_size=40), max_size=5))
def test_counts_of_any_text(texts):
    got = quality_rules.counted([t.encode() for t in texts])
    assert [tuple(r) for r in got.tolist()] == [counts_by_hand(t) for t in texts]


def test_quality_rules_on_odd_rows(spark, docs_of):
    rows = [(i, t) for i, t in enumerate([*TEXTS, "a b c " * 40, "word " * 49, " ".join(f"w{i}" for i in range(50)), "same line\n" * 30])]
    rows += [(None, "x"), (3, "one line"), (3, "\n\n\n")]
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = quality_rules.judge(docs_of(rows).withColumn("kept", F.lit(1)), labels).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(counts_by_hand(t))
    assert len(got) == len(rows)
    for r in got:
        said = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert said in texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # one kind of labels: nothing to learn
    assert quality_rules.judge(docs_of([]), labels.where("false")).count() == 0
    kept = quality_rules.keep(docs_of(rows).withColumn("of", F.lit(1)), labels)
    assert kept.count() == sum(r.kept for r in got) and kept.columns == ["doc_id", "text", "lang", "sig", "of"]


def test_quality_rules_on_held_out_labels(spark):
    """Junk goes and clean texts stay, by labels that were not learned from; probabilities say how often they are right."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 1
    got = quality_rules.judge(docs, labels.where(~held)).join(labels.where(held), "doc_id").where("NOT base_failed").select("quality", "probability", "kept").toPandas()
    good = got["quality"] == 1
    assert got["kept"][good].mean() > 0.99 and got["kept"][~good].mean() < 0.05
    assert ((got["probability"] - good) ** 2).mean() < 0.02


def test_model_does_not_depend_on_layout(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a, b = quality_rules.fit(docs, labels), quality_rules.fit(docs.repartition(7, "lang"), labels.repartition(3))
    assert (a.weights == b.weights).all() and (a.slope, a.offset) == (b.slope, b.offset)


def test_calibration_fits_frequencies():
    rng = np.random.default_rng(1)
    margin = rng.normal(size=20_000) * 3
    good = rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * margin - 0.7)))
    slope, offset = quality_rules.calibrated(margin, good)
    assert abs(slope - 0.5) < 0.05 and abs(offset + 0.7) < 0.1
    apart = quality_rules.calibrated(np.array([-900.0, -800.0, 700.0, 900.0]), np.array([False, False, True, True]))
    assert 0 < apart[0] < 1


def test_scratch_folders_end_with_the_application(tmp_path):
    """A driver of its own: its tables can be read until it ends, and are gone then."""
    code = (
        "import os, sys\n"
        "from pyspark.sql import SparkSession\n"
        "from redactory.llm.storage import Scratch\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', sys.argv[1]).getOrCreate()\n"
        "assert Scratch(s, 'job').keep(s.range(5), 'a').count() == 5 and any(x.startswith('job-') for x in os.listdir(sys.argv[1]))\n"
        "s.stop()\n"
    )
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, timeout=120)
    for _ in range(100):
        if not [x for x in os.listdir(tmp_path) if x.startswith("job-")]:
            return
        time.sleep(0.1)
    raise AssertionError(os.listdir(tmp_path))
