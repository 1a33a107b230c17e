"""Benchmark decontamination by greedy string tiling.

Test items are cut into seed windows of five plain words (rolling polynomial fingerprints, as in Karp-Rabin matching).  A document
that shares seeds with an item is tiled against it: seeds grow along their diagonals, the longest match that overlaps no
earlier tile is marked, again and again.  The document is contaminated if tiles cover enough of the item, in any order.

The items are dealt into blocks of bounded size by the hash of their id; each block goes to every task, so a test set of
any size is matched whole, one block after another within the same pass over the documents.

Defined cases: null and empty documents match nothing; a null, empty or shorter item than a seed matches nothing;
repeated items are both reported; repeated documents get equal results; without items nothing is contaminated; input
columns pass through untouched, those named as a result give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiling
from .tiling import MIN_COVERAGE, MIN_MATCH

#: Characters of test items in a block.
BLOCK_CHARS = 4_000_000
MATCH = "array<struct<item_id:long,coverage:double,tiles:int,longest:int>>"


def item_blocks(items: DataFrame, item: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (item id, text), each small enough for the driver and a task."""
    known = items.where(F.col(text).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        yield sorted(((r["item"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def matcher(shared: Broadcast, min_match: int, min_coverage: float):
    """Vectorised function from a text to its matches among the items of one block."""

    @F.pandas_udf(MATCH)
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = tiling.TestItems(shared.value, min_match)
        names = ("item_id", "coverage", "tiles", "longest")
        for batch in batches:
            yield pd.Series([[dict(zip(names, m, strict=True)) for m in index.matches(t, min_coverage)] for t in batch])

    return match


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH,
    min_coverage: float = MIN_COVERAGE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Adds ``contaminated`` and ``matches`` (item, covered share, tiles, longest tile) to ``docs``."""
    docs = docs.drop(*[c for c in ("contaminated", "matches") if c in docs.columns and c != text])
    found = []
    for block in item_blocks(items, item, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found.append(matcher(shared, min_match, min_coverage)(F.col(text)))
    matched = docs.withColumn("_found", F.concat(*found) if len(found) > 1 else found[0])
    return matched.select(*docs.columns, (F.size("_found") > 0).alias("contaminated"), F.col("_found").alias("matches"))
