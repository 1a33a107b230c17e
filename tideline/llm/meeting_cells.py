"""Sets that meet under keys: who may be linked, families of them, and verified links, without pairs within a group.

Sets meet under a key (a shingle, a bucket of a sketch) and in a band of sizes.  Those that meet are points of an R-tree
over count vectors; what its bound leaves together is a family.  A family's whole sets are compared by the tree again and
verified.  Links are spanning: a set already connected to another is not compared with it.

Groups with more than a task's share of rows are dealt into cells: bands of sizes, of which only neighbours can be
linked, cut into blocks by hash; each pair of blocks is a cell of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage
from .count_tree import spanning_links, unpacked

#: Rows and elements of a block of a large group.
BLOCK_ROWS, BLOCK_MARKS = 1024, 4_000_000


def size_band(percent: int) -> Column:
    """Logarithm of the size to the base of the largest ratio of linked sizes: only neighbouring bands can be linked."""
    return F.floor(F.log("size") / math.log(100 / percent) + 1e-9)


def cells(rows: DataFrame, group: str, percent: int) -> DataFrame:
    """Adds ``cell`` and ``side``: a group is a cell, a large one a cell per pair of blocks that can hold links."""
    share = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("held") / BLOCK_MARKS))
    figures = [F.count("*").alias("rows"), F.sum("size").alias("held")]
    banded = rows.withColumn("band", size_band(percent))
    large = banded.groupBy(group).agg(*figures).where((F.col("rows") > BLOCK_ROWS) | (F.col("held") > BLOCK_MARKS)).select(group, F.lit(True).alias("large"))
    blocks = banded.groupBy(group, "band").agg(*figures).select(group, "band", share.alias("blocks"))
    near = lambda step: blocks.select(group, (F.col("band") - step).alias("band"), F.col("blocks").alias(f"blocks{step % 3}"))
    dealt = banded.join(large, group, "left")
    alone = dealt.where("large is null").select(*rows.columns, F.struct(F.lit(0).alias("a"), F.lit(0).alias("i"), F.lit(0).alias("b"), F.lit(0).alias("j")).alias("at"), F.lit(0).alias("side"))
    split = dealt.where("large")
    for step in (0, 1, -1):
        split = split.join(near(step), [group, "band"], "left")
    own = F.pmod(F.xxhash64("set"), F.col("blocks0")).cast("int")
    spot = lambda a, i, b, j: F.struct(a.cast("int").alias("a"), i.cast("int").alias("i"), b.cast("int").alias("b"), j.cast("int").alias("j"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    here = F.transform(upto(F.col("blocks0")), lambda j: F.struct(spot(F.col("band"), F.least(own, j), F.col("band"), F.greatest(own, j)).alias("at"), F.when(own <= j, 0).otherwise(1).alias("side")))
    after = F.transform(upto(F.coalesce("blocks1", F.lit(0))), lambda j: F.struct(spot(F.col("band"), own, F.col("band") + 1, j).alias("at"), F.lit(0).alias("side")))
    before = F.transform(upto(F.coalesce("blocks2", F.lit(0))), lambda j: F.struct(spot(F.col("band") - 1, j, F.col("band"), own).alias("at"), F.lit(1).alias("side")))
    split = split.select(*rows.columns, F.explode(F.concat(here, after, before)).alias("_c")).select(*rows.columns, "_c.at", "_c.side")
    both = alone.unionByName(split)
    whole = (F.col("at.a") == F.col("at.b")) & (F.col("at.i") == F.col("at.j"))
    cell = F.concat_ws(":", F.col(group), "at.a", "at.i", "at.b", "at.j")
    return both.select(*[c for c in rows.columns if c != group], cell.alias("cell"), F.when(whole, F.lit(-1)).otherwise(F.col("side")).alias("side"))


def linked_within(dealt: DataFrame, percent: int, verify: bool, tasks: int) -> DataFrame:
    """(a, b): spanning links of every cell; cells lie side by side in a partition and are taken one by one."""

    def close(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held) if len(held) > 1 else held[0]
        names, sizes = rows["set"].tolist(), rows["size"].to_numpy(np.int64)
        linked = None
        if verify:
            sets = [np.frombuffer(m, np.uint64) for m in rows["marks"]]

            def linked(i: int, j: int) -> bool:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

        side = rows["side"].to_numpy()
        found = spanning_links(sizes, unpacked(rows["point"].tolist()), percent, linked, None if side[0] < 0 else side)
        return pd.DataFrame([(names[i], names[j]) for i, j in found], columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for batch in batches:
            names = batch["cell"].to_numpy()
            if held and names[0] != last:
                yield close(held)
                held = []
            last = names[-1]
            starts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, z in zip(starts, starts[1:]):
                held.append(batch.iloc[a:z])
                if z < len(names):
                    yield close(held)
                    held = []
        if held:
            yield close(held)

    spread = dealt.repartition(tasks, "cell").sortWithinPartitions("cell")
    return spread.mapInPandas(run, "a binary, b binary")


#: Rows that a task of the join takes on the average, once there are enough for ``FEW_TASKS`` tasks.
TASK_ROWS, FEW_TASKS = 16_384, 64


def _tasks(rows: int) -> int:
    return max(1, min(FEW_TASKS, rows // 256), rows // TASK_ROWS)


def distinct_meetings(keyed: DataFrame, percent: int) -> DataFrame:
    """(set, size, meeting) of the (set, size, key) that meet others under a key in a band of sizes; staged.

    A set stands in its band and the next, so sets that can be linked stand in one band together.  Meetings of the same
    sets say the same: one of them stands for all.
    """
    met_keys = stage(keyed.groupBy("key").count().where("count > 1").select("key"))
    band = size_band(percent)
    met = keyed.join(small(met_keys, 16), "key").select("set", "size", F.explode(F.array(band, band + 1)).alias("band"), "key")
    met = stage(met.select("set", "size", F.xxhash64("key", "band").alias("meeting")))
    who = [F.bit_xor(F.xxhash64("set", F.lit(k))).alias(f"h{k}") for k in range(2)]
    meeting = met.groupBy("meeting").agg(F.count("*").alias("n"), *who).where("n > 1")
    chosen = stage(meeting.groupBy("n", "h0", "h1").agg(F.min("meeting").alias("meeting")).select("meeting"))
    return stage(met.join(small(chosen, 16), "meeting").select("set", "size", F.col("meeting").cast("string").alias("meeting")))


def met_links(rows: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(a, b) that connect the sets of each meeting which the bound leaves together; ``points`` has (set, point)."""
    dealt = stage(cells(rows, "meeting", percent)).join(points, "set")
    return stage(linked_within(dealt, percent, verify=False, tasks=_tasks(rows.count())))


def family_links(members: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Verified (a, b) that connect whatever links among the members (set, size, family, point) connect; ``whole`` has (set, marks)."""
    found = stage(whole)
    dealt = stage(cells(members.select("set", "size", "family"), "family", percent))
    dealt = dealt.join(members.select("set", "point"), "set").join(found, "set")
    return stage(linked_within(dealt, percent, verify=True, tasks=_tasks(members.count())))
