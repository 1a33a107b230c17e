"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: About so many labelled rows of each class are learnt from; the bound is a parameter of both classifiers.
SAMPLE_PER_LABEL = 8_000
FOLD_MODULUS, HELD_FOLD = 5, 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int = SAMPLE_PER_LABEL, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text, label, weight) of a sample of the learning folds.

    A row is taken if the hash of its id is below bound / rows of its class: the sample is the same in every run, its
    size is bounded, and ``weight`` makes up for classes that were thinned out.  Of several labels of a document the
    highest counts; null ids and null labels teach nothing; a document that stands twice is taken twice.
    """
    known = labels.where(F.col(doc).isNotNull() & F.col(label).isNotNull()).groupBy(doc).agg(F.max(label).cast("int").alias("label"))
    known = known.where((fold(doc, FOLD_MODULUS) != HELD_FOLD) & F.col("label").isin(0, 1))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, per_label / n))).otherwise(share)
    draw = F.shiftrightunsigned(F.xxhash64(F.col(doc), F.lit(label)), 11) / F.lit(float(2**53))
    taken = known.withColumn("share", share).where(draw < F.col("share"))
    # Bounded: some 2 * per_label rows of an id and a label.
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).join(F.broadcast(taken.withColumnRenamed(doc, "doc")), "doc")
    return rows.select("doc", "text", "label", F.try_divide(F.lit(1.0), F.col("share")).alias("weight"))
