"""Line dedup by a log-template tree, in DataFrame functions only.

A line is parsed at fixed depth: first by its number of tokens, then by its leading tokens.  Tokens with a digit are
variable fields.  In a leaf with several different lines, a position behind the leading tokens is constant if one token
stands there in at least half of the leaf's lines and in two of them at least, else variable; lines that agree with
enough of these constants share the leaf's template, every other line is a template of its own.  A template that occurs
in several documents is dropped everywhere but at its first occurrence (least id, then row, then line).

Only lines of leaves with different lines are cut into token rows, and each different line once, so a line that stands
in a third of all documents is one row by then.

Defined cases: a null text stays null, lines without a token stay; a line repeated within one document only stays;
rows equal in id and text are one document and get the same text; null ids come first in the order; an empty table gives
an empty result; other input columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, small, stage

#: Leading tokens of the tree, least tokens of a generalised line, share of the other tokens that must agree with the
#: leaf's constants, documents from which on a template recurs.
DEPTH, MIN_TOKENS, AGREEMENT, MIN_DOCUMENTS = 4, 6, 0.6, 2
BLANK, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
FIELD = "<*>"


#: A whole token with a digit: ``WORD`` without its retries from every letter of a token that has none.
_MASKED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: What a line has that is not its tokens with one space between them already.
_ODD = r"[0-9\x09-\x0D]|\x20(?:\x20|\z)|\A\x20"


def spelled(line: Column) -> Column:
    """Tokens of a line with one space between them, fields with digits masked.

    Tokens hold no blank, so equal texts are equal tokens and no array is made of them here.
    """
    masked = F.regexp_replace(F.regexp_replace(line, _MASKED, FIELD), BLANK, " ")
    return F.when(line.rlike(_ODD), F.trim(masked)).otherwise(line)


def parsed_lines(docs: DataFrame, doc: str, text: str, depth: int) -> DataFrame:
    """(doc, row, line, said, n, leaf) of every line with a token: its tokens, how many, and the leaf of the tree."""
    # The key is made below the explode, once a document and not once a line.
    keyed = docs.select(F.col(doc).alias("doc"), row_key(doc, text).alias("row"), F.split(text, "\n").alias("all"))
    lines = keyed.select("doc", "row", F.posexplode("all").alias("line", "said"))
    cut = lines.where(F.ltrim("said", F.lit(" \t\n\x0b\f\r")) != "").withColumn("said", spelled(F.col("said")))
    cut = cut.withColumn("n", F.octet_length("said") - F.octet_length(F.replace("said", F.lit(" "), F.lit(""))) + 1)
    return cut.withColumn("leaf", F.xxhash64("n", F.substring_index("said", " ", depth)))


def recurring_lines(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS, agreement: float = AGREEMENT,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """(row, drops): positions of the lines to drop, for the rows that have some."""
    parsed = parsed_lines(docs, doc, text, depth)
    own = (F.xxhash64("said").alias("k1"), F.xxhash64(F.lit(1), "said").alias("k2"))
    lines = stage(parsed.select("doc", "row", "line", "leaf", *own, "n"))
    leaves = lines.where(F.col("n") >= min_tokens).groupBy("leaf", "k1", "k2").agg(F.count("*").alias("c")).groupBy("leaf").agg(F.count("*").alias("lines"))
    mixed = stage(leaves.where("lines > 1"))

    # Mixed leaves have lines of enough tokens only; a condition on ``n`` here would be pushed below the steps and repeat them.
    wide = parsed.select("leaf", "said").join(small(mixed, 32), "leaf", "left_semi")
    different = wide.select("leaf", *own, "said").groupBy("leaf", "k1", "k2").agg(F.first("said").alias("said"))
    parts = F.split("said", " ")
    different = stage(different.select("leaf", "k1", "k2", F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth, F.lit(0))).alias("tail")))
    counted = different.select("leaf", F.posexplode("tail").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count("*").alias("c"))
    best = counted.groupBy("leaf", "at").agg(F.max(F.struct("c", "token")).alias("best"))
    const = best.join(mixed, "leaf").select("leaf", "at", F.when((2 * F.col("best.c") >= F.col("lines")) & (F.col("best.c") >= 2), F.col("best.token")).alias("token"))
    whole = const.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("all")).select("leaf", F.col("all.token").alias("template"))
    agree = F.aggregate(F.zip_with("tail", "template", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    # Templates of the tree: the lines that agree with the constants of their leaf.
    general = different.join(whole, "leaf").where(agree >= agreement * F.size("tail")).select("leaf", "k1", "k2", F.lit(True).alias("general"))

    keyed = lines.join(general, ["leaf", "k1", "k2"], "left")
    as_leaf = F.coalesce("general", F.lit(False))
    keyed = stage(keyed.select("doc", "row", "line", F.when(as_leaf, F.col("leaf")).otherwise(F.col("k1")).alias("t1"), F.when(as_leaf, F.lit(0)).otherwise(F.col("k2")).alias("t2")))
    once = keyed.groupBy("t1", "t2", "doc", "row").agg(F.min("line").alias("line"))
    first = F.min(F.struct("doc", "row", "line")).alias("first")
    recurs = stage(once.groupBy("t1", "t2").agg(F.count("*").alias("documents"), first).where(F.col("documents") >= min_documents).select("t1", "t2", "first"))
    later = (F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line"))
    dropped = keyed.join(small(recurs, 64), ["t1", "t2"]).where(later)
    return dropped.groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("drops"))


def drop_recurring(docs: DataFrame, doc: str = "doc_id", text: str = "text", **settings: float) -> DataFrame:
    """``docs`` with ``text`` without its recurring lines, and ``n_dropped`` (an input column of that name gives way)."""
    docs = docs.drop("n_dropped") if text != "n_dropped" else docs
    drops = stage(recurring_lines(docs, doc, text, **settings)).withColumnRenamed("row", "_tideline_row").withColumnRenamed("drops", "_tideline_drops")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("_tideline_drops", i)), "\n")
    out = docs.withColumn("_tideline_row", row_key(doc, text)).join(small(drops, 160), "_tideline_row", "left")
    cols = [F.when(F.col("_tideline_drops").isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns]
    return out.select(*cols, F.coalesce(F.size("_tideline_drops"), F.lit(0)).alias("n_dropped"))
