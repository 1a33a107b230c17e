"""Registered queries of the operators that judge or score each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_pairs, deleted_interpolation, divergence, nearest_votes
from .common import fold, ship, table
from .labelled import FOLD_MODULUS, HELD_FOLD
from .registry import llm_query


@llm_query("op4_quality_divergence")
def op4_quality_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against the language references of the same corpus."""
    ship(spark, "textkit", "divergence")
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    refs = [tuple(r) for r in divergence.references(docs).collect()]
    out = divergence.judge(docs.select("doc_id", "text"), refs)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest", "char_distance", "word_distance"
    )


@llm_query("op9_nearest_votes")
def op9_nearest_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled examples."""
    ship(spark, "textkit", "vote_index", "nearest_votes")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = nearest_votes.fit(docs, table(spark, folder, "labels"))
    held = (fold("doc_id", FOLD_MODULUS) == HELD_FOLD).alias("held_out")
    return nearest_votes.score(docs, model).select("doc_id", held, "score", "predicted", "evidence")


@llm_query("op8_additive_pairs")
def op8_additive_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by the additive model."""
    ship(spark, "textkit", "gam", "additive_pairs")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = additive_pairs.fit(docs, table(spark, folder, "labels"))
    held = (fold("doc_id", FOLD_MODULUS) == HELD_FOLD).alias("held_out")
    return additive_pairs.score(docs, model).select("doc_id", held, "score", "predicted")


@llm_query("op6_deleted_interpolation")
def op6_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    """log10 probabilities of every document under the interpolated model of all learning documents."""
    ship(spark, "textkit", "gram_counts", "interpolation", "deleted_interpolation")
    return deleted_interpolation.score_documents(table(spark, folder, "documents").select("doc_id", "text"))
