"""All registered operator queries and the pipeline."""

import corpus_pipeline

from . import queries_copies, queries_documents, queries_format, queries_manifest, queries_pages, queries_search  # noqa: F401
from .registry import QUERIES, SQL

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["QUERIES", "SQL"]
