"""Ranked lexical search, reversed: the stated queries are indexed and the documents stream through the index.

1. The terms of the items form a vocabulary.  One pass over the documents writes each document's number of terms and its
   counts of vocabulary terms; sums over that table give the corpus figures (documents, terms, document frequencies).
2. The items' terms become an inverted index (term to items) that every task gets.  A task streams its documents' counts
   through it, adds the contributions up per item and keeps the best documents of each item in a heap of bounded size.
3. The heaps of all tasks are merged per item.

Items are taken in blocks of bounded size, so the index that is sent has a fixed bound whatever the number of items; each
block is searched over all documents.  A task holds one block's index, its heaps and one document at a time.

Defined cases: terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z
lower-cased; null and empty texts have no terms; items without terms find nothing; items with one id are ranked each on
their own and repeat the id; repeated documents all compete; a document with a null id ranks last among equal scores;
without documents or items the result is empty; other input columns take no part.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

TOP = 10
#: Bytes of item text in a block (an item of its own if it is longer).
BLOCK_BYTES = 4 << 20
#: Bytes that are part of a term keep their value (A-Z lower-cased); all others part terms.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text.  What parts them is ASCII, so bytes can be told apart without decoding."""
    return bytes(text).translate(_TERM_BYTES).split(b" ") if text else []


def counts(text: bytes | None, vocabulary: dict[bytes, int]) -> tuple[int, list[int], list[int]]:
    """Number of terms, and ids and counts of those in the vocabulary."""
    found = terms(text)
    some = Counter(map(vocabulary.get, found))
    some.pop(None, None)
    return len(found) - found.count(b""), list(some), list(some.values())


def item_blocks(items: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[object, frozenset[bytes]]]]:
    """Blocks of (id, distinct terms); rows come one partition at a time, and only one block is held."""
    block, size = [], 0
    for row in items.select(F.col(item).alias("item"), F.col(text).cast("binary").alias("text")).toLocalIterator():
        held = len(row["text"] or b"")
        if block and size + held > block_bytes:
            yield block
            block, size = [], 0
        distinct = frozenset(terms(row["text"])) - {b""}
        if distinct:
            block.append((row["item"], distinct))
            size += held
    if block:
        yield block


def term_counts(docs: DataFrame, doc: str, text: str, vocabulary: Broadcast) -> DataFrame:
    """(doc, n, terms, tfs) of every document with a term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.value
        for batch in batches:
            rows = [(d, *counts(t, known)) for d, t in zip(batch["doc"].array, batch["text"], strict=True)]
            out = pd.DataFrame([r for r in rows if r[1]], columns=["doc", "n", "terms", "tfs"])
            out["doc"] = out["doc"].astype(batch["doc"].dtype)
            yield out

    kind = docs.schema[doc].dataType.simpleString()
    cols = docs.where(F.length(text) > 0).select(F.col(doc).alias("doc"), F.col(text).cast("binary").alias("text"))
    return cols.mapInPandas(run, f"doc {kind}, n long, terms array<int>, tfs array<long>")


def term_weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def length_norm(n: int, documents: int, all_terms: int) -> int:
    return 10 + (90 * n * documents) // all_terms


class ItemIndex:
    """Inverted index of a block: weights of its terms and, per term, the items that hold it."""

    def __init__(self, weights: np.ndarray, starts: np.ndarray, holders: np.ndarray, n_items: int):
        self.weights, self.starts, self.holders, self.n_items = weights, starts, holders, n_items

    def scores(self, ids: np.ndarray, tfs: np.ndarray, norm: int) -> np.ndarray:
        """Scores of one document for all items."""
        worth = self.weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * norm))
        first, many = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(many)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - many), many)
        out = np.zeros(self.n_items, np.int64)
        np.add.at(out, self.holders[at], np.repeat(worth, many))
        return out


class Heaps:
    """The best documents of every item so far; the root of a heap is the one that leaves first."""

    def __init__(self, n_items: int, top: int):
        self.top, self.heaps, self.least = top, [[] for _ in range(n_items)], np.ones(n_items, np.int64)

    def offer(self, doc: object, scores: np.ndarray) -> None:
        for i in np.flatnonzero(scores >= self.least).tolist():
            heap, entry = self.heaps[i], (int(scores[i]), _Later(doc))
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif heap[0] < entry:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[i] = heap[0][0]

    def rows(self) -> pd.DataFrame:
        found = [(i, e[1].doc, e[0]) for i, heap in enumerate(self.heaps) for e in heap]
        return pd.DataFrame(found, columns=["item", "doc", "score"])


class _Later:
    """Orders ids so that a later one is less: descending, null first."""

    __slots__ = ("doc",)

    def __init__(self, doc: object):
        self.doc = doc

    def __lt__(self, other: _Later) -> bool:
        if self.doc is None or other.doc is None:
            return self.doc is None and other.doc is not None
        return self.doc > other.doc

    def __eq__(self, other: object) -> bool:
        return self.doc == other.doc


def best_of_tasks(counted: DataFrame, index: Broadcast, documents: int, all_terms: int, top: int) -> DataFrame:
    """(item, doc, score): the heaps of each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = index.value
        heaps = Heaps(items.n_items, top)
        for batch in batches:
            known = [None if pd.isna(d) else d for d in batch["doc"].array]
            for d, n, ids, tfs in zip(known, batch["n"].tolist(), batch["terms"], batch["tfs"], strict=True):
                if len(ids):
                    heaps.offer(d, items.scores(ids, tfs, length_norm(n, documents, all_terms)))
        yield heaps.rows()

    kind = counted.schema["doc"].dataType.simpleString()
    return counted.mapInPandas(run, f"item int, doc {kind}, score long")


def search(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(``item``, rank, ``doc``, score): the ``top`` documents of every item with a score above 0, equal scores by id."""
    spark = docs.sparkSession
    item_type = items.schema[item].dataType.simpleString()
    found = []
    for block in item_blocks(items, item, item_text, block_bytes):
        words = sorted(frozenset().union(*(t for _, t in block)))
        ids = {w: i for i, w in enumerate(words)}
        vocabulary = spark.sparkContext.broadcast(ids)
        counted = stage(term_counts(docs, doc, text, vocabulary))
        total = counted.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        if not total["documents"]:
            break
        seen = np.zeros(len(words), np.int64)
        for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            seen[row["term"]] = row["count"]
        held = sorted((ids[w], i) for i, (_, t) in enumerate(block) for w in t)
        starts = np.searchsorted([w for w, _ in held], np.arange(len(words) + 1))
        weights = np.array([term_weight(total["documents"], f) for f in seen.tolist()], np.int64)
        index = spark.sparkContext.broadcast(ItemIndex(weights, starts, np.array([i for _, i in held]), len(block)))
        heaps = best_of_tasks(counted, index, total["documents"], total["terms"], top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        best = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(block)], f"item int, name {item_type}")
        found.append(stage(best.join(names, "item").select(F.col("name").alias(item), "rank", F.col("doc").alias(doc), "score")))
        vocabulary.unpersist()
        index.unpersist()
    if not found:
        return spark.createDataFrame([], f"{item} {item_type}, rank int, {doc} {docs.schema[doc].dataType.simpleString()}, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
