"""Thin queries over the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, lines, minhash, packing, quality, scoring, substrings, token_counts, topk
from .common import table


def op1_perspective_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x.start.cast("string"), x.end.cast("string"))), ",")
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("spans", spans)


def op2_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op6_fast_similarity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op10_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES = {
    "op1_perspective_chat": op1_perspective_chat,
    "op2_risk_controlled_rules": op2_risk_controlled_rules,
    "op3_attention_scores": op3_attention_scores,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_deletion_neighbourhood": op5_deletion_neighbourhood,
    "op6_fast_similarity_sketch": op6_fast_similarity_sketch,
    "op7_token_counts": op7_token_counts,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_relative_lempel_ziv": op9_relative_lempel_ziv,
    "op10_bit_sliced_top_k": op10_bit_sliced_top_k,
}

WORDS = r"SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"

ORACLES: dict[str, str] = {
    "op1_perspective_chat": chat.ORACLE,
    "op2_risk_controlled_rules": quality.oracle_sql(),
    "op5_deletion_neighbourhood": lines.ORACLE,
    "op6_fast_similarity_sketch": f"""
WITH RECURSIVE w AS ({WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
), g AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER five AS g, count(*) OVER five AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM w WINDOW five AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), s AS (
  SELECT DISTINCT doc_id, g FROM g WHERE k = 5 OR n < 5 AND i = 1
), z AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT b, c FROM r JOIN l ON a = doc_id
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept FROM documents d JOIN r USING (doc_id) LEFT JOIN z USING (doc_id) GROUP BY d.doc_id
""",
    "op9_relative_lempel_ziv": f"""
WITH w AS ({WORDS.format(text="coalesce(text, '')")}
), g AS (
  SELECT *, CASE WHEN count(*) OVER o = 13 THEN string_agg(word, ' ') OVER o END AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), f AS (
  SELECT g, min(doc_id) AS first FROM g WHERE g IS NOT NULL GROUP BY g
), c AS (
  SELECT doc_id, i, word, coalesce(bool_or(first < doc_id) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM g LEFT JOIN f USING (g)
)
SELECT d.doc_id, count(i) AS n_words, count(i) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id
""",
    "op10_bit_sliced_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
""",
}
