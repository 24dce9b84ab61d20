"""Models: held-out accuracy, brute force, and rows that are odd."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from redactory.llm import html_pages, html_tree, neighbours, pii, quality, queries, shingles, toxicity


def test_hashed_words_are_the_same_in_any_segment(monkeypatch):
    data = ("é a bb  ccc\tdddd\n" * 400).encode()
    whole = shingles.hash_words(data)
    monkeypatch.setattr(shingles, "SEGMENT", 7)
    parts = shingles.hash_words(data)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert [data[a:b] for a, b in zip(whole[0], whole[1], strict=True)] == data.split()
    assert len(set(whole[2].tolist())) == 5


def test_quality_parts_good_from_bad(spark):
    """On labels that neither the model nor the threshold has seen."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 1
    got = quality.classify(docs, labels.where(~held)).join(labels.where(held), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.97 and kept[0] < 0.15


def test_sampling_follows_the_weights(spark):
    """The first of many samples of four, and the second in it, come as often as drawing in proportion to weights without replacement says."""
    w, temperature, n = np.array([1.0, 2.0, 4.0, 8.0]), 2.0, 20_000
    rows = spark.range(4 * n).select((F.col("id") / 4).cast("long").alias("sample"), "id", F.concat(F.lit("text "), "id").alias("text"), (F.col("id") % 4).alias("which"))
    rows = rows.withColumn("key", F.log(F.pow(F.lit(2.0), F.col("which"))) / temperature + quality.gumbel(1, "id", "text"))
    drawn = rows.groupBy("sample").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("key", "which")))), lambda x: x["which"]).alias("order"))
    count = {(r.a, r.b): r["count"] for r in drawn.groupBy(F.col("order")[0].alias("a"), F.col("order")[1].alias("b")).count().collect()}
    p = w ** (1 / temperature)
    for a in range(4):
        for b in range(4):
            if a != b:
                assert abs(count[a, b] / n - p[a] / p.sum() * p[b] / (p.sum() - p[a])) < 0.015


def test_sample_by_hand(spark, docs_of):
    """Kept documents are those of the largest keys, and scores are sums over n-grams counted by hand."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(words[:7] if i % 2 else words[1:], 1 + i % 4))) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(docs_of(rows), labels).collect()}
    counts = np.zeros((2, quality.BUCKETS + 1))
    for i, t in rows:
        for codes in quality.buckets([t.encode()])[:2]:
            np.add.at(counts[1], codes, 1)
            if i % 2:
                np.add.at(counts[0], codes, 1)
    target, raw = (np.log((c[:-1] + 1) / (c[:-1].sum() + quality.BUCKETS)) for c in counts)
    for i, t in rows:
        codes = np.concatenate(quality.buckets([t.encode()])[:2])
        codes = codes[codes != quality.NONE]
        assert abs(out[i].log_weight - (target - raw)[codes].sum()) < 1e-5 and out[i].n_grams == len(codes)
    kept = sorted((r.key for r in out.values()), reverse=True)[: sum(r.kept for r in out.values())]
    assert all(r.kept == (r.key >= kept[-1]) for r in out.values()) and 0 < len(kept) < 80
    plain = sorted(out.values(), key=lambda r: -r.log_weight)[: len(kept)]
    assert any(not r.kept for r in plain), "noise must have a part in the sample"


def test_quality_of_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    rows = [(1, "good words are here and there " * 5), (2, "BAD!! BAD!! BAD!! " * 9), (3, None), (4, ""), (5, "x"), (5, "x"), (6, "y" * 200_000), (None, "no id")]
    out = quality.classify(docs_of(rows), labels).collect()
    assert len(out) == len(rows) and all(math.isfinite(r.score) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1].log_weight > by[2].log_weight and by[3].score == by[4].score == 0 and by[3].n_grams == 0
    assert quality.resample(docs_of(rows), labels).columns == docs_of(rows).columns
    assert quality.classify(docs_of([]), labels).count() == 0
    assert all(r.kept for r in quality.classify(docs_of(rows), labels.limit(0)).collect())


def test_scores_like_a_count_of_grams(docs_of):
    text = "the cat the the cat"
    gram, word, at, first = quality.buckets([text.encode(), b"", b"ab"])
    assert (gram[at[0] : at[1]] != quality.NONE).sum() == len(text) - 2 and first.tolist() == [0, 10, 10, 12]
    assert (word == quality.SAME).sum() == 1


def test_largest_key(spark):
    values = [5.0, 1.0, 5.0, 3.5, -2.0, 7.0]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    assert [quality.largest(keys, k, bins=2) for k in range(1, 7)] == sorted(values, reverse=True)


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8 and n.get((0, 1), 0) / n[0, 0] < 0.05


def test_toxicity_of_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)] + [(None, 1)], "doc_id long, toxic int")
    rows = [(i, f"plain words number {i} stand here " + ("you idiot and moron " if i % 2 == 0 else "you friend and helper ")) for i in range(200)] + [(300, None), (301, ""), (302, "i d i o t m o r o n"), (303, "idxiot mor.on 1d10t"), (304, "z" * 100_000), (305, "friend")]
    out = {r.doc_id: r for r in toxicity.score(docs_of(rows), labels).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    assert out[303].score > out[305].score and out[300].score == out[301].score
    assert toxicity.score(docs_of(rows), labels.limit(0)).count() == len(rows)
    assert toxicity.score(docs_of([]), labels).count() == 0


def test_short_texts_are_judged_by_their_words(spark):
    """Learned from sf0.1: held-out rows, texts of few words, and columns named as those made inside."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs.withColumn("__toxic", F.lit(1)).withColumn("toxic", F.lit(1)), labels)
    bad, good = model.score(["you are an idiot", "moron", "what a m o r o n you are", "st.upid"]), model.score(["hello my friend", "thanks a lot for help", "", "of the and", "7 !!"])
    assert (bad >= 0.3).all() and (good < 0.3).all()
    rows = docs.join(labels, "doc_id").where(toxicity.held_out("doc_id") & F.col("toxic").isNotNull()).select("text", "toxic").toPandas()
    score, y = model.score([t or "" for t in rows["text"]]), rows["toxic"].to_numpy()
    above = (score[y == 1][:, None] > score[y == 0]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0]).mean()
    assert above >= 0.95


def test_score_by_hand():
    """Margins and scores from every subsequence of three letters, one by one."""
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(size=1 << 15).astype(np.float32), -0.1, rng.normal(size=toxicity.WIDTH), 0.1)

    def margin(word):
        codes = toxicity.letters(word)
        if not codes:
            return toxicity.LOWEST
        best = toxicity.LOWEST
        for at in range(0, max(1, len(codes) - 12), 12):
            c = ([0] if at == 0 else []) + codes[at : at + 24] + ([0] if at + 24 >= len(codes) else [])
            total = norm = 0.0
            for i in range(len(c)):
                for j in range(i + 1, len(c)):
                    for k in range(j + 1, min(len(c), i + 6)):
                        total += 0.5 ** (k - i + 1) * model.weight[(c[i] << 10) | (c[j] << 5) | c[k]]
                        norm += 0.25 ** (k - i + 1)
            best = max(best, min(2.0, max(-2.0, total / math.sqrt(norm or 1) - 0.1)))
        return best

    texts = ["idiot friend st.upid", "one", "", "i d i o t yes", "идиот 愚か者 ok", "w" * 70 + " x", "... !!", "many words stand here and more of them"]
    for text, got in zip(texts, model.score(texts), strict=True):
        words = text.split() + (["idiot"] if text.startswith("i d") else [])
        m = sorted(map(margin, words), reverse=True)
        above = [math.log1p(sum(x > t for x in m)) for t in (0, 0.25, 0.5, 1)]
        x = np.array([max(0, v) for v in [*m[:4], 0, 0, 0, 0][:4]] + above + [max([-0.5, *m]), math.log1p(len(words)), 1])
        assert abs(got - 1 / (1 + math.exp(-x @ model.document))) < 1e-4, text


def test_every_script_has_letters():
    assert all(len(toxicity.letters(w)) == len(w) for w in ("идиот", "愚か者", "ηλίθιος", "अबक")) and toxicity.letters("2б") != toxicity.letters("2в")


def test_kernel_is_the_sum_over_subsequences():
    words = ["idiot", "idxiot", "stupid"]
    base = toxicity.profiles(words)
    assert np.allclose(toxicity.kernel(words, base), base.T @ base, atol=1e-5)
    k = toxicity.kernel(words, base)
    assert k[0, 1] > k[0, 2]


def test_neighbours_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_ivf_pq(spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = total = 0
    for q, v in zip(ids, x, strict=True):
        if q % 20:
            continue
        s = x @ v
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(abs(r.score - s[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-9 for r in own)
        found, total = found + len({r.vec_id for r in own} & set(best.tolist())), total + 20
    assert found / total >= 0.9


def test_neighbours_of_a_vector_that_most_queries_hold(spark):
    """Lists say nothing about it, and all about the other queries."""
    rng = np.random.default_rng(7)
    n = 3000
    x = np.zeros((n, 64))
    directions = rng.normal(size=(50, 32))
    x[:, :32] = (directions / np.sqrt((directions * directions).sum(1))[:, None])[rng.integers(0, 50, n)] + 0.05 * rng.normal(size=(n, 32))
    x[:, 32:] = 0.01 * rng.normal(size=(n, 32))
    asking = np.arange(0, n, 10)
    x[asking[rng.random(len(asking)) < 0.7]] = np.concatenate([np.zeros(32), 1e-4 * rng.normal(size=32)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("id") % 10 == 0, probes=4, least_rows=1, shortlist=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = 0
    for q in asking.tolist():
        s = x @ x[q]
        s[q] = -np.inf
        found += len(got[q] & set(np.lexsort((np.arange(n), -s))[:20].tolist()))
    assert found / (20 * len(asking)) >= 0.9


def test_neighbours_of_many_vectors_without_direction(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64)).astype(np.float32).astype(float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[1::50] = x[1]  # copies must not fill a shortlist
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = 0
    for q in range(0, 20_000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        found += len(got[q] & set(np.lexsort((np.arange(len(s)), -s.round(12)))[:20].tolist()))
    assert found / 200 / 20 >= 0.95


def test_neighbours_of_a_large_list_in_cells(spark):
    """A third of all vectors is in one list: it is cut into cells, and cells and packs of any size give the same rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    x[::3] = 5 * x[0] + 0.05 * x[::3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = [sorted(map(tuple, neighbours.search(df, F.col("id") % 20 == 0, k=5, lists=12, probes=3, least_rows=10, **sizes).collect())) for sizes in ({}, {"block": 16, "part": 4, "query_block": 7})]
    assert got[0] == got[1] and len(got[0]) == 75 * 5
    found = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        found += len({r[2] for r in got[0] if r[0] == q} & set(np.argsort(-s, kind="stable")[:5].tolist()))
    assert found / len(got[0]) >= 0.95


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (20, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert neighbours.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_pages_not_seen_in_training():
    model, right, total = html_tree.train(), 0, 0
    for page, labels in html_pages.labelled(60, seed=123):
        tree = html_tree.parse(page)
        got = [odds > 0 for odds, t in zip(model.messages(tree)[2], tree.leaf, strict=True) if t is not None]
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.98


def test_marginals_like_a_sum_over_all_labellings():
    tree = html_tree.parse("<body><div><p>a b c</p><p>d</p></div><nav><a href=x>e</a></nav>")
    rng = np.random.default_rng(0)
    model = html_tree.Model(rng.normal(size=html_tree.FEATURES), rng.normal(size=(2, 2, 2)))
    n = len(tree.parent)
    weight = np.zeros((n, 2))
    for state in range(1 << n):
        y = [state >> i & 1 for i in range(n)]
        s = sum(y[i] * sum(model.own[f] for f in tree.features[i]) for i in range(n)) + sum(model.pair[int(tree.leaf[i] is not None)][y[tree.parent[i]]][y[i]] for i in range(1, n))
        for i in range(n):
            weight[i, y[i]] += math.exp(s)
    assert np.allclose(model.messages(tree)[2], np.log(weight[:, 1] / weight[:, 0]))


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<p>a &amp; b&nbsp;c<br>d<p>e", ["a & b c d", "e"]), ("<ul><li>a<li><b>b</b> c</ul>d", ["a", "b c", "d"]), ("x<!-- y -->z<script>q</script> w", ["xz w"]), ("<div title='a>b'>t</div>", ["t"]), ("a < b", ["a < b"]), ("<p>cut off &am", ["cut off &am"]), ("t<p cl", ["t"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("<div>a<p>b</div>c", ["a", "b", "c"]), ("</p></div>x", ["x"]), ("<!-- open", []), ("<STYLE>p{}</STYLE>k", ["k"]),
    ],
)
def test_blocks(page, blocks):
    assert [t for t in html_tree.parse(page).leaf if t is not None] == blocks


def test_extraction_query(spark, sf):
    for r in queries.op5_tree_model_html(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        import html

        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_extraction_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p"), (4, "<article><p>" + "word " * 50_000 + "</article>"), (4, "<div>" * 3000), (5, "plain text")]
    out = html_tree.extract(spark.createDataFrame([(i, h, "t") for i, h in rows], "page_id long, html string, url string")).collect()
    assert len(out) == len(rows) and [r.text for r in out if r.page_id in (1, 2, 3)] == ["", "", ""] and [r.n_chars for r in out if r.page_id == 4 and r.html.startswith("<art")] == [249_999]


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    out = []
    for k, (_, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub(r"\D", "", m[0])
            fine = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[k]
            out += [(m.start(), k, m.end())] if fine else []
    return sorted(out)


def test_base_spans_like_the_patterns(spark, sf):
    rng = np.random.default_rng(3)
    bits = ["4111111111111111", "a.b@c.de", "@", "1.2.3.4", "256.1.1.1", "+1 (212) 555-0100", " ", "-", ".", "+", "9", "é", "x@y", "0001.2.3.4", "5500 0000 0000 0004"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 9))) for _ in range(3000)] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert [pii.base_spans(t) for t in texts] == [plain_spans(t) for t in texts]


def test_the_field_finds_what_it_has_seen_elsewhere(docs_of):
    rows = [(i, f"call me at +1 (212) 555-{i:04d} or write u{i}@mail.example.com today") for i in range(300)] + [(1000, "ask +1 (212) 555-7713 now; later try (212) 555-7713 again"), (1001, None), (1002, ""), (1003, "no data at all"), (1004, "x " * 100_000), (1005, "version 2.0 of 2024")]
    out = {r.doc_id: r for r in pii.find(docs_of(rows)).collect()}
    assert any(not s.base and s.kind == "phone" for s in out[1000].pii)
    assert all(not out[i].pii for i in (1001, 1002, 1003, 1004, 1005)) and len(out) == len(rows)
    hidden = {r.doc_id: r.text for r in pii.redact(docs_of(rows)).collect()}
    assert hidden[1001] is None and hidden[1003] == "no data at all" and hidden[3] == "call me at <PHONE> or write <EMAIL> today" and "7713" not in hidden[1000]
    assert pii.find(docs_of([])).count() == 0 and pii.find(docs_of([(1, "nothing 12")])).first().pii == []


def test_runs_of_number_tokens_are_one_node():
    def said(text):
        return [(text[a:b], k) for a, b, k in pii.nodes(text, pii.base_spans(text))]

    assert said("call +1 415 555 2671 today, again 415 555 2671 ok") == [("+1 415 555 2671", 3), ("415 555 2671", -1)]
    assert said("+1 (212) 555-7713, in 2020 212 555 7713 12 times") == [("+1 (212) 555-7713", 3), ("2020", -1), ("212 555 7713", -1), ("12", -1)]
    assert said("4 5\n6 x7 8") == [("4 5", -1), ("6", -1), ("x7", -1), ("8", -1)]
    assert said("j.doe@a.example, then j.doe(at)a.example; J.Doe said") == [("j.doe@a.example", 0), ("j.doe(at)a.example", -1), ("J.Doe", -1)]
    long = " ".join(["123456"] * 50_000)
    assert "".join(t for t, _ in said(long)).replace(" ", "") == long.replace(" ", "") and max(len(pii.digits_of(t)) for t, _ in said(long)) <= pii.RUN_DIGITS
    assert said("") == said("no data") == []


def test_training_raises_the_likelihood_of_hidden_labels():
    made = [x for i in range(60) for x in pii.lessons(f"call +1 (212) 555-{i:04d} or write u{i}@mail.example.com in 2024 with 17 of {i} items", 2)]
    g, label = pii._joined([g for g, _ in made]), np.concatenate([y for _, y in made])
    hidden = np.flatnonzero((g.seen < 0) & (label >= 0))
    likely = [np.log(pii.train(g, label, 0.7, rounds).marginals(g)[hidden, label[hidden]]).mean() for rounds in (1, 20, 150)]
    assert likely[0] < likely[1] < likely[2] and likely[2] > math.log(0.9)


def test_hidden_repetitions_are_found(spark):
    """Held-out texts: a value's later occurrences are hidden from the patterns; and copies written otherwise, among decoys."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    field = pii.fit(docs.where(half), train_docs=100_000)
    texts = sorted({r.text for r in docs.where(~half).collect()})
    found, wanted = [], []
    for i, t in enumerate(texts):
        shown, hidden, known = [], [], set()
        for s, k, e in pii.base_spans(t):
            (hidden if (k, t[s:e]) in known else shown).append((s, k, e))
            known.add((k, t[s:e]))
        if hidden:
            wanted += [(i, *h) for h in hidden]
            found += [(i, *h) for h in field.added([t], [shown])[0]]
    assert len(wanted) >= 20
    right = len(set(found) & set(wanted))
    assert right >= 0.8 * len(wanted) and right >= 0.9 * len(found)
    made = [pii.lessons(t, 1)[0] for t in texts]
    g, label = pii._joined([g for g, _ in made]), np.concatenate([y for _, y in made])
    p, ask = field.marginals(g), (g.seen < 0) & (label >= 0)
    best = np.where(p.max(1) >= field.least, p.argmax(1), pii.OTHER)
    right = (ask & (label != pii.OTHER) & (best == label)).sum()
    assert right >= 0.8 * (ask & (label != pii.OTHER)).sum() and right >= 0.9 * (ask & (best != pii.OTHER)).sum()


def test_pii_of_odd_rows(spark, docs_of):
    """Repeated ids and rows, nulls, long texts, columns named as those made inside."""
    text = "ask +1 (212) 555-7713 or u.1@mail.example.com"
    rows = [(1, text), (1, text), (1, None), (None, text), (2, ""), (3, "+ @ (at) [at] 1.2.3 " * 20_000), (4, "@" * 5000)]
    docs = docs_of(rows).withColumn("pii", F.lit("x")).withColumn("hash", F.lit(1)).withColumn("features", F.lit(2))
    out = pii.find(docs).collect()
    assert len(out) == len(rows) and {(r.hash, r.features) for r in out} == {(1, 2)}
    assert [[(s.kind, s.base) for s in r.pii] for r in out if r.text == text] == [[("phone", True), ("email", True)]] * 3
    assert all(not [s for s in r.pii if s.base] for r in out if r.text != text)
    field = pii.fit(docs)
    assert sorted(map(str, pii.find(docs, field=field).collect())) == sorted(map(str, out))
    assert pii.redact(docs_of([(7, None), (8, "of")]), field=field).orderBy("doc_id").collect()[1].text == "of"


def test_messages_like_a_sum_on_a_tree():
    texts = ["a1 b2 c3"]
    g = pii.graph(texts, [[]])
    rng = np.random.default_rng(4)
    field = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)), 0.8)
    own, total = field.local[g.features].sum(1), np.zeros((3, 5))
    for y in np.ndindex(5, 5, 5):
        s = sum(own[i, y[i]] for i in range(3)) + sum(field.chain[y[i], y[i + 1]] for i in range(2))
        for i in range(3):
            total[i, y[i]] += math.exp(s)
    assert len(g.chain) == 2 and np.allclose(field.marginals(g, rounds=100), total / total.sum(1, keepdims=True), atol=1e-2)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] >= kept[3] == kept[4] > 0
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == kept[-1] and out.where("n_tokens = 0").count() == 0


def test_pipeline_rows_of_one_id(spark):
    """One document of each group stays: rows are told apart by id and text, ids may be missing, other columns have any names."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (7, text), (7, "unrelated text of some words here"), (None, text), (9, "a b c d e f g h"), (9, "a b c d e f g h"), (3, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, key string, row string")
    got = corpus_pipeline.ngram_jaccard_join(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, text), (7, "unrelated text of some words here"), (9, "a b c d e f g h"), (3, None), (None, "")], key=str)
    masked = corpus_pipeline.pii_masking(spark, docs, "").collect()
    assert len(masked) == len(rows) and {r.key for r in masked} == {"x"}
