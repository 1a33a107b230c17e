"""Registered queries of the operators that compare documents with each other or with the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_templates, ngram_join, prob_minhash, string_tiling
from .common import ship, table
from .line_templates_sql import LINE_SQL
from .registry import llm_query


@llm_query("op1_line_templates", LINE_SQL)
def op1_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines whose template stands in an earlier document too."""
    return line_templates.drop_recurring(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_dropped", "text")


@llm_query("op5_prob_minhash")
def op5_prob_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document; the class id is the least document id in it."""
    ship(spark, *prob_minhash.SHIPPED)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return prob_minhash.near_duplicates(docs).select("doc_id", "class_id", "kept")


@llm_query("op2_string_tiling")
def op2_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against every benchmark item: items it covers, and how much of the best."""
    ship(spark, "textkit", "tiling")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = string_tiling.contamination(docs, table(spark, folder, "benchmark").select("item_id", "text"))
    best = F.coalesce(F.array_max(F.col("matches.coverage")), F.lit(0.0))
    return out.select("doc_id", "contaminated", F.array_sort(F.col("matches.item_id")).alias("item_ids"), best.alias("coverage"))


JOIN_SQL = r"""
WITH RECURSIVE said AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS gram FROM said
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM grams x JOIN grams y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * both >= 90 * (sa.n + sb.n - both)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT said.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, least(said.doc_id, (SELECT min(b) FROM reach WHERE reach.a = said.doc_id)) AS component_id
FROM said LEFT JOIN sizes USING (doc_id)
"""


@llm_query("op13_ngram_join", JOIN_SQL)
def op13_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of three-word shingles."""
    ship(spark, *prob_minhash.SHIPPED, "ngram_join")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ngram_join.similar(docs).select("doc_id", "n_shingles", "component_id")
