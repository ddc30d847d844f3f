"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"), threshold=0.8, words=5)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"), min_words=50).select("doc_id", "n_lines", "n_deleted", "text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.lm_score import backoff_scores

    return backoff_scores(_table(spark, sf_dir, "documents"), order=3, alpha=0.4)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.bpe_chunks import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), digest=True)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.packing import best_fit_pack

    return best_fit_pack(_table(spark, sf_dir, "documents"), capacity=2048)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=1024)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.topk_search import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), k=20, scale=64)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_jaccard_join, op2_line_dedup, op3_toxicity, op4_lm_scores, op5_quality,
        op6_bpe_round_trip, op7_best_fit_packing, op8_token_counts, op9_embedding_dedup, op10_top_k,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op4_lm_scores": OP4, "op9_embedding_dedup": OP9, "op10_top_k": OP10}


#: Pairs of equal labels by brute force; components by the least id over a transitive closure.
OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), u AS (
  SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v
  WHERE x IS NOT NULL AND label IS NOT NULL AND list_dot_product(x, x) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS low FROM r GROUP BY a), d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(least(c.low, vec_id), vec_id) AS component_id,
  coalesce(least(c.low, vec_id), vec_id) = vec_id AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN d ON d.a = v.vec_id
"""

#: Every query against every other row.
OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Every shortest run of 50 words from each line on and up to each line, compared as text.
OP2 = """
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a
  FROM documents
), n AS (
  SELECT doc_id, i, a[i] AS line, len(list_filter(string_split(a[i], ' '), lambda w: w <> '')) AS w
  FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM l)
), c AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM n
), r AS (
  SELECT DISTINCT s.doc_id, s.i AS s, e.i AS e FROM c s JOIN c e ON s.doc_id = e.doc_id AND e.i >= s.i
    AND e.upto - s.upto + s.w >= 50 AND (e.upto - e.w - s.upto + s.w < 50 OR e.upto - s.upto < 50)
), t AS (
  SELECT r.*, array_to_string(list_slice(l.a, r.s, r.e), chr(10)) AS run FROM r JOIN l USING (doc_id)
), f AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM t
), d AS (
  SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s, e + 1)) AS i FROM f WHERE k > 1) GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(l.a) AS INTEGER) AS n_lines, CAST(coalesce(len(d.gone), 0) AS INTEGER) AS n_deleted,
  CASE WHEN d.gone IS NULL THEN l.text ELSE array_to_string(list_filter(l.a, lambda x, i: NOT list_contains(d.gone, i)), chr(10)) END AS text
FROM l LEFT JOIN d USING (doc_id)
"""

#: Counts of all other documents: the whole corpus less the document's own.
OP4 = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS a FROM documents
), w AS (
  SELECT doc_id, i, a[i] AS g1, CASE WHEN i > 1 THEN a[i - 1] || ' ' || a[i] END AS g2,
    CASE WHEN i > 2 THEN a[i - 2] || ' ' || a[i - 1] || ' ' || a[i] END AS g3
  FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM d)
), n AS (
  SELECT doc_id, i,
    count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY g1, doc_id) AS c1,
    CASE WHEN g2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY g2, doc_id) END AS c2,
    CASE WHEN g3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY g3, doc_id) END AS c3
  FROM w
), p AS (
  SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS p1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS p2 FROM n
), t AS (SELECT count(*) AS n FROM w), m AS (SELECT doc_id, count(*) AS own FROM w GROUP BY doc_id), s AS (
  SELECT doc_id, own, sum(CASE
    WHEN c3 > 0 THEN ln(c3) - ln(p2)
    WHEN c2 > 0 THEN ln(0.4) + ln(c2) - ln(p1)
    WHEN c1 > 0 THEN 2 * ln(0.4) + ln(c1) - ln(greatest(n - own, 1))
    ELSE 3 * ln(0.4) - ln(greatest(n - own, 1)) END) AS score
  FROM p JOIN m USING (doc_id), t GROUP BY doc_id, own
)
SELECT d.doc_id, CAST(coalesce(own, 0) AS BIGINT) AS n_words, round(coalesce(score, 0), 6) AS log_score, round(coalesce(score / own, 0), 6) AS score FROM d LEFT JOIN s USING (doc_id)
"""
