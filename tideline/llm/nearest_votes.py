"""Toxicity by the nearest labelled examples.

Terms are all plain words of the labelled sample and the heads of longer ones, rare ones and those of either label.
Every document is compared with every labelled example by the exact cosine of TF-IDF vectors over these terms in an
inverted index; the nearest vote by distance, leave-one-out votes choose the number of voters and calibrate, and the
nearest examples are given as evidence.

Defined cases: null and empty texts, and texts without a term, get the share of label 1 among examples without a term;
equal examples are one vector with their votes summed, ties are broken by a fixed order of vectors; without labels every
score is 0.5 (nothing is known); repeated rows get equal results; an empty table gives an empty result; other input
columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vote_index
from .common import stage
from .labelled import SAMPLE_PER_LABEL, labelled_sample

THRESHOLD = 0.5
RESULT = "score double, predicted int, evidence array<struct<doc_id:long,cosine:double,share:double>>"


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = SAMPLE_PER_LABEL, doc: str = "doc_id", text: str = "text",
    calibrated: int = vote_index.CALIBRATED,
) -> vote_index.VoteModel:
    """Learns from about ``per_label`` rows of each class; only they reach the driver, as keys and counts of their terms.

    ``calibrated`` of them choose the number of voters and calibrate the votes.
    """
    sample = stage(labelled_sample(docs, labels, label, per_label, doc, text))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(vote_index.features(t), return_counts=True) for t in batch["text"]]
            # Counts in as few bytes as the largest of the document needs.
            keys, times = [k.tobytes() for k, _ in found], [n.astype(np.min_scalar_type(n.max(initial=0))).tobytes() for _, n in found]
            yield pd.DataFrame({"doc": batch["doc"], "keys": keys, "times": times, "label": batch["label"], "weight": batch["weight"]})

    # Partition by partition, as the driver's JVM would hold all rows at once beside Python.
    rows, terms, new = [], np.empty(0, np.uint64), []
    for r in sample.mapInPandas(count, "doc long, keys binary, times binary, label int, weight double").toLocalIterator():
        rows.append((r["doc"], bytes(r["keys"]), bytes(r["times"]), r["label"], r["weight"]))
        new.append(np.frombuffer(rows[-1][1], np.uint64))
        if len(new) == 500:
            terms, new = np.unique(np.concatenate([terms, *new])), []
    terms = np.unique(np.concatenate([terms, *new]))
    # One order in every run, or the sums of weights would differ in their last bits.
    rows.sort(key=lambda r: r[:4])
    seen, total = np.zeros(len(terms)), 0.0
    examples = []
    while rows:
        who, keys, times, label, weight = rows.pop()
        which = np.searchsorted(terms, np.frombuffer(keys, np.uint64)).astype(np.int32)
        seen[which] += weight
        total += weight
        examples.append((who, which, np.frombuffer(times, f"u{len(times) // max(len(which), 1) or 1}"), label, weight))
    idf = 1.0 + np.log((1.0 + total) / (1.0 + seen))
    model = vote_index.VoteModel(terms, idf, examples, calibrated)
    return model.calibrate(left_out_votes(docs.sparkSession, model))


def left_out_votes(spark: SparkSession, model: vote_index.VoteModel) -> np.ndarray:
    """Leave-one-out votes of the held examples, in their order; tasks build the index, the driver never does."""
    # Scores use the same copy: a task's process builds the index once.
    shared = model.shared = spark.sparkContext.broadcast(model)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "votes": list(shared.value.left_out(batch["id"].tolist()))})

    out = np.empty((len(model.held), len(vote_index.VOTERS)))
    for row in spark.range(len(model.held)).mapInPandas(vote, "id long, votes array<double>").collect():
        out[row["id"]] = row["votes"]
    return out


def score(docs: DataFrame, model: vote_index.VoteModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score, predicted and evidence to ``docs``; input columns of these names give way."""
    # Bounded: the sample's terms and distinct vectors.
    shared = model.shared or docs.sparkSession.sparkContext.broadcast(model)
    fitted = model.voters, model.slope, model.offset

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value.fitted(*fitted)
        for batch in batches:
            found = known.score_all(batch.tolist())
            evidence = [[{"doc_id": i, "cosine": c, "share": s} for i, c, s in e] for _, e in found]
            yield pd.DataFrame({"score": [p for p, _ in found], "predicted": [int(p >= threshold) for p, _ in found], "evidence": evidence})
        vote_index.give_back()

    docs = docs.drop(*[c for c in ("score", "predicted", "evidence") if c in docs.columns and c != text])
    return docs.withColumn("_vote", judge(F.col(text))).select(*docs.columns, "_vote.*")
