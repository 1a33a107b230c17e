"""Near-duplicate classes by ProbMinHash, banding and exact verification.

1. Each document gets a content key (its words in order) and ProbMinHash bands of its distinct five-word shingles.
   Documents with one content key are copies; only one of them goes on.
2. Contents that share a band key and can be of linked sizes meet.  Those whose sets the bound by count vectors leaves
   together make families (``meeting_cells``).
3. The whole sets of a family's members are verified by their Jaccard similarity; a content that is already connected to
   another is not compared with it, so a crowd of near copies costs a spanning forest of links, never all pairs.
4. Links give connected components.

No linked pair of a bucket is lost, and a family may add links that no bucket held.

Defined cases: null and empty texts are copies of each other; other texts without words are copies if equal; a text of
fewer than five words is one shingle; a row with a null id is a document as any other, classes take the least id that is
not null; equal rows are copies; an empty table gives an empty result; other input columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prob_sketch
from .common import row_key, small, stage
from .meeting_cells import distinct_meetings, family_links, met_links
from .textkit import plain_word_keys

#: Modules that tasks need.
SHIPPED = ("textkit", "count_tree", "meeting_cells", "prob_sketch", "prob_minhash")
SIMILARITY = 0.8
#: Characters whose documents a task sketches at once.
SKETCH_CHARS = 1_500_000


def sketches(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, row, content, bands, size, point) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = batch["text"].str.len().fillna(0).cumsum() // SKETCH_CHARS
            for _, part in batch.groupby(held, sort=False):
                contents, bands, sizes, points = prob_sketch.sketch(part["text"].tolist())
                yield pd.DataFrame({"doc": part["doc"], "row": part["row"], "content": contents, "bands": bands, "size": sizes, "point": points})

    cols = docs.select(F.col(doc).alias("doc"), row_key(doc, text).alias("row"), F.col(text).alias("text"))
    return cols.mapInPandas(run, f"doc {docs.schema[doc].dataType.simpleString()}, row long, content binary, bands array<long>, size long, point binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, doc: str, text: str) -> DataFrame:
    """(set, marks) of the wanted (row, set): the rows are found again in the table by their key, contents by their name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content, t in zip(batch["set"], batch["text"], strict=True):
                keys = plain_word_keys(t)
                if prob_sketch.content_key(t, keys) == bytes(content):
                    rows.append((content, prob_sketch.distinct(keys).tobytes()))
            yield pd.DataFrame(rows, columns=["set", "marks"])

    texts = docs.select(row_key(doc, text).alias("row"), F.col(text).alias("text"))
    return texts.join(small(wanted, 100), "row").select("set", "text").mapInPandas(run, "set binary, marks binary").dropDuplicates(["set"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``edges`` (a, b); the label is the least node of the component.

    Labels spread along edges and are then followed one step (pointer jumping), so long chains close in a few rounds.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        after = stage(spread.join(ahead, "label").select("node", "old", F.least("label", "jump").alias("label")))
        moved = after.where("old <> label").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels


def links(docs: DataFrame, sketched: DataFrame, doc: str, text: str, similarity: float) -> DataFrame:
    """Verified links (a, b) between contents; they connect all contents that linked pairs within buckets connect."""
    percent = round(100 * similarity)
    one = sketched.where("bands is not null").groupBy("content").agg(F.min(F.struct("row", "size", "bands", "point")).alias("one"))
    contents = stage(one.select(F.col("content").alias("set"), "one.*"))
    rows = distinct_meetings(contents.select("set", "size", F.explode("bands").alias("key")), percent)
    families = components(met_links(rows, contents.select("set", "point"), percent))
    members = families.select(F.col("node").alias("set"), F.hex("label").alias("family"))
    members = stage(members.join(contents.select("set", "row", "size", "point"), "set"))
    return family_links(members, whole_sets(docs, members.select("row", "set"), doc, text), percent)


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``doc``, ``row`` (its key), ``class_id`` (least id of the class), ``kept``.

    ``kept`` marks the documents with the least id of their class and the least row key among them; of equal rows all
    carry the same mark.
    """
    sketched = stage(sketches(docs, doc, text))
    labels = components(links(docs, sketched, doc, text, similarity))
    named = sketched.select("doc", "row", "content").join(labels.withColumnRenamed("node", "content"), "content", "left").withColumn("label", F.coalesce("label", "content"))
    named = stage(named.select("doc", "row", "label"))
    # Least id that is not null, and the row that has it.
    least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("first")
    classes = named.groupBy("label").agg(least)
    out = named.join(classes, "label")
    return out.select(F.col("doc").alias(doc), "row", F.col("first.doc").alias("class_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are kept; of rows equal in id and text one stays."""
    marked = stage(near_duplicates(docs, doc, text, similarity))
    gone = stage(marked.where(~F.col("kept")).select(F.col("row").alias("_tideline_row")).distinct())
    twice = stage(marked.where("kept").groupBy("row").count().where("count > 1").select(F.col("row").alias("_tideline_row")))
    keyed = docs.withColumn("_tideline_row", row_key(doc, text)).join(small(gone, 16), "_tideline_row", "left_anti")
    again = small(twice, 16)
    kept = keyed.join(again, "_tideline_row", "left_anti").unionByName(keyed.join(again, "_tideline_row", "left_semi").dropDuplicates(["_tideline_row"]))
    return kept.select(*docs.columns)
