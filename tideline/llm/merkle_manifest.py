"""Merkle manifest of a table: a tree of digests per group, one root over the groups, and an inclusion proof per row.

A row is a leaf: the SHA-256 of its fields.  Leaves of a group stand in the order of the key.  While a group has several
nodes, every ``FAN`` consecutive ones (the last run may have fewer, even one) become the digest of their digests.  The
last node of a group is its subroot; subroots, in the order of the groups (null first), make one more such tree.

Per level a window over blocks of whole runs gives each node the lag and lead columns 1 to FAN - 1.  They are masked by
the node's slot in its run and by the length of the run: what is left are its siblings.  The first child of a run hashes
itself and the nodes ahead of it into the parent, and only first children go up to the next level.

Scale: places come from a range sort (ids within its partitions plus the partitions' counts), never from a window over
a group, so a group of any size is spread over all tasks; a window holds ``BLOCK`` nodes.  A level has an eighth of the
rows of the one below.  Going down, a node joins the path of its parent, so rows meet a table of an eighth of their number.

Defined cases: a null field is ``-``; null keys stand first; null is a group of its own; equal keys stand in the order of
their leaves, so repeated rows are leaves of their own with one digest; a group of one row has its leaf as subroot and
no siblings; an empty table gives an empty result; other input columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stage

FAN = 8
#: Nodes of a window partition: whole runs of one level.
BLOCK = FAN**2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated strings."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of the fields, each as ``-`` or its number of UTF-8 bytes, a colon and its value."""
    said = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said])


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``_pos`` (from 0) within ``_group`` in the given order and ``_n``, the rows of the group."""
    by = [F.col(c).asc_nulls_first() for c in ("_group", *order)]
    # The last key parts rows that agree in all others, so that a range never ends up with all of them.
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = stage(spread.repartitionByRange(*by, "_tie").sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    piece = F.shiftright("_at", 33)
    pieces = ordered.groupBy("_group", piece.alias("_piece")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stage(pieces.select("_group", "_piece", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("_n")))
    out = ordered.withColumn("_piece", piece).join(small(starts, 100), ["_group", "_piece"])
    return out.withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_piece", "_shift")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``_left`` and ``_right``: digests of the siblings before and after; ``_parent`` at first children."""
    near = Window.partitionBy("_group", F.expr(f"_pos div {BLOCK}")).orderBy("_pos")
    slot = F.col("_pos") % FAN
    run = F.least(F.lit(FAN), F.col("_n") - F.col("_pos") + slot)
    lags = [F.when(slot >= j, F.lag("_digest", j).over(near)).otherwise("") for j in range(FAN - 1, 0, -1)]
    leads = [F.when(slot + j < run, F.lead("_digest", j).over(near)).otherwise("") for j in range(1, FAN)]
    out = nodes.withColumns({"_left": F.concat(*lags), "_right": F.concat(*leads)})
    return out.withColumn("_parent", F.when((slot == 0) & (F.col("_n") > 1), digest(F.col("_digest"), F.col("_right"))))


def parents(level: DataFrame) -> DataFrame:
    """The next level of the groups that still have several nodes."""
    fan = F.lit(FAN)
    up = level.where("_parent is not null")
    return up.select("_group", F.expr(f"_pos div {FAN}").alias("_pos"), F.ceil(F.col("_n") / fan).alias("_n"), F.col("_parent").alias("_digest"))


def climb(base: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels with siblings, from the leaves on, and (``_group``, ``_top``)."""
    levels = [stage(with_siblings(base))]
    most = levels[0].agg(F.max("_n")).first()[0] or 0
    while most > 1:
        levels.append(stage(with_siblings(parents(levels[-1]))))
        most = -(-most // FAN)
    tops = [level.where("_n = 1").select("_group", F.col("_digest").alias("_top")) for level in levels]
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return levels, stage(out)


_PATH = "array<struct<l:string,r:string>>"


def descend(levels: Sequence[DataFrame]) -> DataFrame:
    """The leaves with ``_path``: siblings before and after, level by level up to the group's top."""
    here = F.when(F.col("_n") > 1, F.array(F.struct(F.col("_left").alias("l"), F.col("_right").alias("r")))).otherwise(F.array().cast(_PATH))
    above = None
    for level in reversed(levels):
        own = level.withColumn("_path", here).drop("_left", "_right", "_parent")
        if above is not None:
            up = above.select("_group", F.col("_pos").alias("_up"), F.col("_path").alias("_rest"))
            own = own.withColumn("_up", F.expr(f"_pos div {FAN}")).join(up, ["_group", "_up"], "left")
            own = own.withColumn("_path", F.concat("_path", F.coalesce("_rest", F.array().cast(_PATH)))).drop("_up", "_rest")
        above = own
    return above


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, order: str = "doc_id", group: str = "lang", changed: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``order``, ``group``, ``leaf``, ``checked_leaf``, ``subroot``, ``root``, ``path``.

    ``changed`` maps fields to the values found at a later check; ``checked_leaf`` is the leaf of the row with these.
    """
    changed = changed or {}
    now = [F.col(c) for c in fields]
    later = [changed.get(c, F.col(c)) for c in fields]
    rows = docs.select(
        F.col(order).alias("_key"), F.col(group).alias("_of"),
        # Not null, and ordered as the group is: null first, then by bytes.
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_group"),
        leaf_digest(now).alias("_digest"), leaf_digest(later).alias("_checked"),
    )
    levels, tops = climb(placed(stage(rows), ["_key", "_digest", "_checked"]))
    crown = placed(tops.select(F.lit("").alias("_group"), F.col("_group").alias("_name"), F.col("_top").alias("_digest")), ["_name"])
    upper, root = climb(crown)
    # One row: the whole table's digest.
    whole = root.first()
    heads = descend(upper).select(
        F.col("_name").alias("_group"), F.col("_digest").alias("subroot"), F.lit(whole and whole["_top"]).cast("string").alias("root"), F.col("_path").alias("_crown")
    )
    heads = small(stage(heads), 2_000)
    out = descend(levels).join(heads, "_group")
    return out.select(
        F.col("_key").alias(order), F.col("_of").alias(group), F.col("_digest").alias("leaf"), F.col("_checked").alias("checked_leaf"), "subroot", "root",
        F.concat("_path", "_crown").alias("path"),
    )


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["l"], node, s["r"]))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)
