"""Similarity join of documents by the Jaccard similarity of their distinct three-word shingles, and its components.

1. Documents with one shingle set are copies: one of them, named by 128 bits of the set, goes on.
2. Linked sets share one of the first shingles of each in any common order (as many as may be missing, and one).  The
   order is rarest first, by a count sketch of fixed size over all documents, so few sets meet and what many documents
   share hardly counts.  The sketch only orders: whatever its errors, no linked pair is lost.
3. The sets that meet under a shingle and in a band of sizes are points of an R-tree (``count_tree``): their elements hashed into groups, the
   overlap bounded by the sum of coordinate minima.  Sets that the bound leaves together make families.  A family holds
   every link of its members, and only members of families are read again, once each.
4. A family's sets go through the tree again; pairs that the bound leaves are verified on the whole sets.  A set already
   connected to another is not compared with it, so a crowd of near copies yields a spanning forest, never all pairs.

Groups (of a shingle, or a family) with more than a task's share of rows are dealt into cells: bands of sizes, of which
only neighbours can be linked, cut into blocks by hash; each pair of blocks is a cell of its own.

Defined cases: words are maximal runs of anything but ASCII white space, A-Z lower-cased; with fewer than three words the
whole sequence is one shingle; a text without words (or null) has no shingle, no link and its own id as component; a null
id is a document like any other, a component has the least id that is not null; repeated rows are copies; an empty table
gives an empty result; other input columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, small, stage
from .count_tree import point
from .meeting_cells import distinct_meetings, family_links, met_links
from .prob_minhash import components
from .textkit import lowered_run_keys, shingles

PERCENT, WORDS = 90, 3
#: Counters of the sketch (4 MB as sent to tasks), and of one row of it.
COUNTERS, CHUNK = 1 << 20, 4096


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct shingle keys, sorted."""
    return np.unique(shingles(lowered_run_keys(text), words)) if text else np.empty(0, np.uint64)


def set_name(marks: np.ndarray) -> bytes:
    return hashlib.blake2b(marks.tobytes(), digest_size=16).digest()


def _counter(marks: np.ndarray) -> np.ndarray:
    return (marks >> np.uint64(64 - 20)).astype(np.int64)


def shingle_counts(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """The count sketch: documents per counter, added up on Spark in chunks; its size is fixed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, size = np.zeros(COUNTERS, np.int64), [], 0
        for batch in batches:
            for t in batch["text"]:
                held.append(_counter(shingle_set(t, words)))
                size += len(held[-1])
                if size > COUNTERS:
                    total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        parts = total.reshape(-1, CHUNK)
        yield pd.DataFrame({"chunk": np.arange(len(parts)), "counts": [p.tobytes() for p in parts]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for c in rows["counts"]:
            total += np.frombuffer(c, np.int64)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "counts": [total.tobytes()]})

    parts = docs.select(F.col(text).alias("text")).mapInPandas(count, "chunk int, counts binary")
    # First within groups of tasks: what one group gathers grows with the root of their number.
    some = parts.withColumn("part", F.spark_partition_id() % 64).groupBy("part", "chunk").applyInPandas(add, "chunk int, counts binary")
    out = np.zeros((COUNTERS // CHUNK, CHUNK), np.int64)
    for row in some.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect():
        out[row["chunk"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(out.ravel(), (1 << 24) - 1).astype(np.uint32)


def prefix(marks: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which a linked set has one: the first in the order of counts, those level with the last included."""
    keep = len(marks) - -(-percent * len(marks) // 100) + 1
    rank = (counts[_counter(marks)].astype(np.uint64) << np.uint64(40)) | (marks & np.uint64((1 << 40) - 1))
    return marks[rank <= np.partition(rank, keep - 1)[keep - 1]]


def described(docs: DataFrame, doc: str, text: str, shared: Broadcast, percent: int, words: int) -> DataFrame:
    """(doc, row, set, size, keys, point) of every row; no set, keys and point without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        for batch in batches:
            names, sizes, keys, spots = [], [], [], []
            for t in batch["text"]:
                marks = shingle_set(t, words)
                sizes.append(len(marks))
                names.append(set_name(marks) if len(marks) else None)
                keys.append(prefix(marks, counts, percent).view(np.int64) if len(marks) else None)
                spots.append(point(marks) if len(marks) else None)
            yield pd.DataFrame({"doc": batch["doc"], "row": batch["row"], "set": names, "size": sizes, "keys": keys, "point": spots})

    cols = docs.select(F.col(doc).alias("doc"), row_key(doc, text).alias("row"), F.col(text).alias("text"))
    return cols.mapInPandas(run, f"doc {docs.schema[doc].dataType.simpleString()}, row long, set binary, size long, keys array<long>, point binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, doc: str, text: str, words: int) -> DataFrame:
    """(set, marks) of the wanted (row, set): rows are found again by their key, sets by their name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, t in zip(batch["set"], batch["text"], strict=True):
                marks = shingle_set(t, words)
                if set_name(marks) == bytes(name):
                    rows.append((name, marks.tobytes()))
            yield pd.DataFrame(rows, columns=["set", "marks"])

    texts = docs.select(row_key(doc, text).alias("row"), F.col(text).alias("text"))
    return texts.join(small(wanted, 100), "row").select("set", "text").mapInPandas(run, "set binary, marks binary").dropDuplicates(["set"])


def links(docs: DataFrame, known: DataFrame, doc: str, text: str, percent: int, words: int) -> DataFrame:
    """Verified links (a, b) between different shingle sets; they connect whatever all links connect."""
    one = known.where("set is not null").groupBy("set").agg(F.min(F.struct("row", "size", "keys", "point")).alias("one"))
    sets = stage(one.select("set", "one.*"))
    rows = distinct_meetings(sets.select("set", "size", F.explode("keys").alias("key")), percent)
    families = components(met_links(rows, sets.select("set", "point"), percent))
    members = stage(families.select(F.col("node").alias("set"), F.hex("label").alias("family")).join(sets.select("set", "row", "size", "point"), "set"))
    return family_links(members, whole_sets(docs, members.select("row", "set"), doc, text, words), percent)


def similar(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc``, ``n_shingles`` and ``component_id``.

    Documents are linked when 100 x intersection >= ``percent`` x union of their shingle sets; the component is the
    least id reachable by links.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, text, words))
    known = stage(described(docs, doc, text, shared, percent, words))
    labels = components(links(docs, known, doc, text, percent, words))
    named = known.select("doc", "set", F.col("size").alias("n_shingles")).join(labels, known["set"] == labels["node"], "left")
    named = stage(named.select("doc", "n_shingles", F.coalesce("label", "set").alias("label")))
    least = named.where("label is not null").groupBy("label").agg(F.min("doc").alias("first"))
    out = named.join(least, "label", "left")
    return out.select(F.col("doc").alias(doc), "n_shingles", F.when(F.col("label").isNull(), F.col("doc")).otherwise(F.col("first")).alias("component_id"))
