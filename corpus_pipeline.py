"""Training-data pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, piece encoding.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns a table; ``run`` writes each result as
Parquet in the shared folder and reads it again as the next stage's documents.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import line_templates, nearest_votes, piece_codec, prob_minhash, string_tiling
from tideline.llm.common import ship, stage, table
from tideline.llm.queries_format import PIECE_MODEL
from tideline.session import configure


def carried(docs: DataFrame) -> DataFrame:
    """Id and text beside the whole row, so that no column of ``docs`` meets one that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("_doc"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not reject."""
    ship(spark, "textkit", "vote_index", "nearest_votes")
    model = nearest_votes.fit(docs, table(spark, sf_dir, "labels"))
    return nearest_votes.score(carried(docs), model).where("predicted = 0").select("_doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template stands in an earlier document; ``n_chars`` follows the text."""
    out = line_templates.drop_recurring(carried(docs))
    changed = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*[changed.get(c, F.col("_doc")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least id."""
    ship(spark, *prob_minhash.SHIPPED)
    return prob_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    ship(spark, "textkit", "tiling")
    found = string_tiling.contamination(carried(docs), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select("_doc.*")


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, and whether they decode to the text and agree with sentencepiece."""
    ship(spark, "piece_codec")
    return piece_codec.code(docs, PIECE_MODEL, results=("n_tokens", "ids", "round_trip", "parity"))


STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("piece_encoding", piece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs


#: Classes, tilings and votes are not SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None
