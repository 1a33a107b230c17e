"""Registered query of the manifest operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merkle_manifest as mm
from .common import table
from .merkle_manifest_sql import MANIFEST_SQL
from .registry import llm_query

#: Rows whose id's crc32 this divides are found tampered with at the later check.
TAMPERED = 3


@llm_query("op11_merkle_manifest", MANIFEST_SQL)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the check of a later version of it."""
    docs = table(spark, folder, "documents").select(*mm.FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    out = mm.manifest(docs, changed={"text": F.when(hit, mm.lower_ascii(F.col("text"))).otherwise(F.col("text"))})
    root = mm.folded(F.col("checked_leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", mm.proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
