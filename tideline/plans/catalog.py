"""All registered queries."""

from . import audit_queries, bundle_queries, cohort_queries, feature_queries, micro_queries, phenotype_queries, repair_queries, weight_queries  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
