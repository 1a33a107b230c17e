"""Registered query of the ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import item_heaps
from .common import ship, table
from .registry import llm_query

_TERMS = r"""regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SEARCH_SQL = f"""
WITH wanted AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
vocabulary AS MATERIALIZED (SELECT DISTINCT term FROM wanted),
said AS MATERIALIZED (SELECT doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL),
lengths AS MATERIALIZED (SELECT doc_id, len(terms)::BIGINT AS n FROM said WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS terms FROM lengths),
tfs AS MATERIALIZED (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM said) SEMI JOIN vocabulary USING (term) GROUP BY ALL
),
weights AS MATERIALIZED (
  SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs CROSS JOIN total GROUP BY term, documents
),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // total.terms))))::BIGINT AS score
  FROM wanted JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) CROSS JOIN total GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""


@llm_query("op12_item_heaps", SEARCH_SQL)
def op12_item_heaps(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    ship(spark, "item_heaps")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return item_heaps.search(docs, table(spark, folder, "benchmark").select("item_id", "text")).select("item_id", "rank", "doc_id", "score")
