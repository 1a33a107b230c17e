"""Registered query of the page operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import host_suffixes
from .common import ship, table
from .registry import llm_query


@llm_query("op3_host_suffixes")
def op3_host_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    ship(spark, "textkit", "page_blocks", "host_suffixes")
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return host_suffixes.main_texts(pages).select("page_id", "url", "text", "n_chars", "n_repeated")
