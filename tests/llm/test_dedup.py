"""Near duplicates, repeated passages and benchmark passages against brute force."""

import collections
import random

import duckdb
import numpy as np
import pytest

from redactory.llm import components, decontaminate, jaccard, queries, repeats
from redactory.llm.storage import Scratch


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def classes(rows, n, percent):
    sets, parent = [shingle_set(t, n) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = collections.defaultdict(lambda: 10**18)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def family(rng, size, copies, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (3, 60)])
def test_jaccard_join(docs_of, n, percent):
    rng = random.Random(n)
    texts = [None, "", " \t", "one", "ONE", "one two", "one  two three", "one two three", "a b c d e", "a b c d e f"]
    for size, copies, edits in ((12, 30, 3), (60, 60, 8), (150, 80, 14), (400, 25, 40)):
        texts += family(rng, size, copies, edits)
    texts += [texts[20]] * 40 + ["shared passage of some words " * 3 + f"own {i} words {i * 7}" for i in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert sorted(map(tuple, jaccard.classes(docs_of(rows), n, percent).collect())) == classes(rows, n, percent)


def test_jaccard_join_of_nothing(docs_of):
    assert jaccard.classes(docs_of([])).count() == 0
    assert [tuple(r) for r in jaccard.classes(docs_of([(5, None)])).collect()] == [(5, 0, 5)]


def test_similar_sets_share_enough_signatures():
    rng = np.random.default_rng(1)
    method = jaccard.PartEnum(85)
    for size in [*range(1, 40), 100, 300, 900]:
        a = np.sort(rng.integers(0, 2**63, size, dtype=np.uint64))
        for gone in range(size * 15 // 100 + 1):
            kept = a[gone:]
            if 100 * len(kept) < 85 * size or not len(kept):
                continue
            (x, need_x), (y, need_y) = method.signatures(a), method.signatures(np.sort(kept))
            x, y = dict(zip(x.tolist(), need_x.tolist(), strict=True)), dict(zip(y.tolist(), need_y.tolist(), strict=True))
            shared = [s for s in x if s in y]
            assert shared
            for of in (x, y):
                assert any(sum(of[s] == need for s in shared) >= need // 2 for need in {of[s] for s in shared})


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(links, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def repeated_words(rows, length):
    seen, out = collections.defaultdict(set), collections.defaultdict(set)
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - length + 1):
            seen[tuple(w[j : j + length])].add(i)
    for i, w in words:
        for j in range(len(w) - length + 1):
            if len(seen[tuple(w[j : j + length])]) > 1:
                out[i].update(range(j, j + length))
    return {i: s for i, s in out.items() if s}


def test_repeated_passages(docs_of):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 130)]
    rows = [(1, None), (2, ""), (3, "short text"), (4, "same " * 300), (5, " ".join(passage[3] * 3))]
    for i in range(10, 60):
        text = [word() for _ in range(rng.randrange(20, 200))]
        for p in rng.sample(passage, rng.randrange(3)):
            at = rng.randrange(len(text))
            text[at:at] = p
        rows.append((i, "  ".join(text)))
    rows += [(100 + i, rows[12][1]) for i in range(30)]
    got = collections.defaultdict(set)
    found = repeats.repeated(docs_of(rows), passage=50).collect()
    for r in found:
        assert r.n_words == r.end_word - r.start_word >= 50 and r.other_id != r.doc_id
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert dict(got) == repeated_words(rows, 50)
    cleaned = {r.doc_id: r.text for r in repeats.remove(docs_of(rows), repeats.repeated(docs_of(rows))).collect()}
    assert cleaned[1] is None and cleaned[4] == "same " * 300 and cleaned[110].split() == [] and len(cleaned) == len(rows)


def test_repeated_passages_around_a_common_line(spark, docs_of):
    """Pairs share words of their own beside a line that very many documents have."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(100_000)}"
    line, rows = [word() for _ in range(30)], []
    for k in range(40):
        before, after = [[word() for _ in range(n)] for n in ((22, 0), (0, 22), (11, 11))[k % 3]]
        for i in (1000 + k, 5000 + k):
            rows.append((i, " ".join([*(word() for _ in range(40)), *before, *line, *after, *(word() for _ in range(40))])))
    rows += [(10_000 + i, " ".join([*(word() for _ in range(40)), *line, *(word() for _ in range(40))])) for i in range(2500)]
    # Best matches to either side are with documents of no passage; the one of both is the neighbour of neither order.
    left, right = [word() for _ in range(34)], [word() for _ in range(34)]
    for i, (a, z) in enumerate(((20, 20), (20, 20), (30, 0), (0, 30), (30, 3), (3, 30))):
        rows.append((90_000 + i, " ".join([*(word() for _ in range(9)), *left[34 - a :], *line[:16], *right[:z], *(word() for _ in range(9))])))
    got = collections.defaultdict(set)
    for r in repeats.repeated(docs_of(rows), passage=50).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert dict(got) == repeated_words(rows, 50)


def test_repeated_passages_of_nothing(docs_of):
    assert repeats.repeated(docs_of([])).count() == 0


def test_contamination_like_its_sql(spark, sf):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, queries.op6_positional_index(spark, sf).collect())) == sorted(duck.execute(queries.OP6_SQL).fetchall())


def test_contamination_of_odd_rows(spark, docs_of):
    items = [(1, "One two three four five six seven eight nine ten eleven"), (2, "Short ITEM"), (3, None), (4, "... !!"), (5, "Élan vital"), (2, "Short ITEM")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "x ONE, two three four five six seven eight nine ten! y"), (2, "a short-item b short item"), (3, None), (4, ""), (5, "élan vital"), (6, "Élan vital"), (7, "short item"), (7, "short item"), (8, "one two three four five six seven eight nine ten eleven twelve")]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in decontaminate.contamination(docs_of(rows), benchmark).collect())
    assert got == [(1, 12, 10, ["1"], True), (2, 6, 4, ["2"], True), (3, 0, 0, [], False), (4, 0, 0, [], False), (5, 2, 0, [], False), (6, 2, 2, ["5"], True), (7, 2, 2, ["2"], True), (7, 2, 2, ["2"], True), (8, 12, 11, ["1"], True)]
    assert decontaminate.contamination(docs_of([]), benchmark).count() == 0
    assert not [r for r in decontaminate.contamination(docs_of(rows), benchmark.limit(0)).collect() if r.contaminated]


def test_proximity(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = [(1, "gamma x alpha y delta z beta"), (2, "alpha beta gamma"), (3, "alpha " + "x " * 30 + "beta gamma delta"), (4, None)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.proximity(docs_of(rows), benchmark, within=8).collect()}
    assert got == {(1, 1)}
