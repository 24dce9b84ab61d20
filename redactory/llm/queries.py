"""One query for each operator of this subpackage, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fill_middle, html_tree, jaccard, neighbours, pii, quality, quality_rules, repeats, token_files, toxicity, vector_codes
from .storage import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated(table(spark, sf_dir, "documents"), passage=50)


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op4_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op5_tree_model_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


def op7_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_string_kernel_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "token-files").root
    shards = token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(shards, folder)


def op10_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(said(F.filter("pii", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), said("pii").alias("spans"))


def op11_ngram_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return coded.withColumn("codebooks_sha256", F.lit(books.sha256() if books else None).cast("string"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=7, rate=100, spm=50)
    restored = fill_middle.restore(F.col("fim.output"), F.col("fim.form"))
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2(F.col("fim.output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored.cast("binary"), 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sparse_suffix_array, op2_importance_resampling, op3_byte_bpe, op4_ivf_pq, op5_tree_model_html, op6_positional_index, op7_partenum_join, op8_string_kernel_svm, op9_token_files, op10_skip_chain_pii, op11_ngram_regression, op12_vector_codes, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op6_positional_index": OP6_SQL, "op12_vector_codes": OP12_SQL, "op13_fill_in_middle": OP13_SQL}


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT doc_id, s, p.n, item_id FROM places p JOIN windows USING (n, phrase)
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM found) GROUP BY doc_id
), of_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN of_items USING (doc_id)
"""

#: One round: sums and counts of each entry's parts, then floors of means (integer division rounds to zero in SQL).
_ROUND = r"""
, near{r} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, d * 256 + e) AS e, min(d) AS far FROM (
    SELECT vec_id, x.p, e, list_sum(list_transform(range(1, 17), lambda i: (x.w[i] - b.w[i]) * (x.w[i] - b.w[i])))::BIGINT AS d FROM parts x JOIN book{r} b ON x.p = b.p
  ) GROUP BY vec_id, p
)"""
_MOVE = r"""
, book{n} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM book{r} b LEFT JOIN (
    SELECT p, e, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY i) AS w FROM (
      SELECT x.p, e, i, sum(x.w[i])::BIGINT AS s, count(*) AS c FROM parts x JOIN near{r} USING (vec_id, p), range(1, 17) t(i) GROUP BY ALL
    ) GROUP BY p, e
  ) m ON b.p = m.p AND b.e = m.e
)"""
OP12_SQL = (
    r"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * 16 + 1 : p * 16 + 16] AS w FROM kept, range(4) t(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, w FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
)"""
    + "".join(_ROUND.format(r=r) + _MOVE.format(r=r, n=r + 1) for r in range(4))
    + _ROUND.format(r=4)
    + r"""
, coded AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM kept JOIN near4 USING (vec_id) GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) FROM book4) AS codebooks_sha256
FROM coded
"""
)

OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents
), picked AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 AS plain, ('0x' || h[25:32])::BIGINT % 100 < 50 AS spm FROM units
), parts AS (
  SELECT doc_id, text, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1 : least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1 : n], '') AS suffix FROM picked
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
