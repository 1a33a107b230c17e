"""Quality by a generalised additive model with pairwise interactions.

Features are bounded shapes of the text alone.  The model is fitted on a bounded labelled sample: only the sample's
feature rows (about ``2 * per_label`` of them) reach the driver.  Scoring is a look-up and an addition per feature and pair.

Defined cases: null and empty texts, and texts without words, have zero features and get the model's score for them;
without labels, or with one class only, every score is the sample's rate; repeated rows get equal results; an empty table
gives an empty result; other input columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gam
from .labelled import SAMPLE_PER_LABEL, labelled_sample

THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = SAMPLE_PER_LABEL, doc: str = "doc_id", text: str = "text") -> gam.AdditiveModel:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc": batch["doc"], "x": [gam.describe(t) for t in batch["text"]], "label": batch["label"], "weight": batch["weight"]})

    sample = labelled_sample(docs, labels, label, per_label, doc, text).mapInPandas(measure, "doc long, x array<double>, label int, weight double")
    rows = sorted(sample.collect(), key=lambda r: (r["doc"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(-1, len(gam.FEATURES))
    return gam.fit(x, np.array([r["label"] for r in rows], float), np.array([r["weight"] for r in rows], float))


def score(docs: DataFrame, model: gam.AdditiveModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to ``docs``; input columns of these names give way."""
    # Bounded: some tables of at most BINS and PAIR_BINS squared entries.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for batch in batches:
            x = np.array([gam.describe(t) for t in batch]).reshape(-1, len(gam.FEATURES))
            yield pd.Series(known.probability(x))

    docs = docs.drop(*[c for c in ("score", "predicted") if c in docs.columns and c != text])
    return docs.withColumn("score", judge(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
