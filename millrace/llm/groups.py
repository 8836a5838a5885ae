"""Links within groups of rows: blocks for the tasks, and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import written

#: Keys of a task: the group and the two blocks of it that meet there.
TASK = ("group", "low", "high")


def in_blocks(rows: DataFrame, item: str, blocks: Column) -> DataFrame:
    """Deal the rows of each ``group`` into ``blocks`` parts and every two parts to a task.

    Every pair of a group meets in one task, and a task holds two blocks at most, however
    large the group is. Columns added: ``block``, ``low``, ``high``. Rows come out
    partitioned and sorted by task.
    """
    own = F.pmod(F.xxhash64(F.col(item), F.lit(77)), F.col("blocks")).cast("int")
    dealt = (
        rows.withColumn("blocks", blocks.cast("int"))
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("blocks", "other")
    )
    return dealt.repartition(*TASK).sortWithinPartitions(*TASK)


def trees(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of a symmetric matrix thinned to a forest: the things that hang, and the
    first of each one's tree. Takes a step for each thing, not for each link."""
    top = np.full(len(linked), -1)
    for start in range(len(linked)):
        if top[start] >= 0:
            continue
        top[start] = start
        reached = [start]
        while reached:
            fresh = np.flatnonzero(linked[reached.pop()] & (top < 0))
            top[fresh] = start
            reached += fresh.tolist()
    hung = np.flatnonzero(top != np.arange(len(linked)))
    return hung, top[hung]


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links between longs to ``(id, component)``: for every id that has a link,
    the smallest id it is connected with.

    Alternates two steps that only group and join by id. Seen from each node, first its
    larger neighbours and then its smaller ones are hung on the smallest neighbour. Paths
    shorten quickly, and no component is ever gathered in one place. The smallest
    neighbours are written down first, so that both sides of each join are scans, which
    adaptive execution splits at a node that has very many links. Nulls and links of a
    node with itself are left out.
    """
    edges = _edges(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), "a", "b").filter("a <> b"))
    while not _is_star(edges):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        edges = _edges(_hung(both, "v > u", itself=False))
        edges = _edges(_hung(edges, "v <> m", itself=True))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _edges(rows: DataFrame) -> DataFrame:
    return written(rows.select("u", "v").filter("u <> v").distinct(), "edges")


def _hung(rows: DataFrame, which: str, itself: bool) -> DataFrame:
    least = written(rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    hung = rows.join(least, "u").filter(which).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select(F.col("u"), F.col("m").alias("v"))) if itself else hung


def _is_star(edges: DataFrame) -> bool:
    """Whether every node that hangs hangs on one node, which itself does not hang."""
    roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        edges.select(F.col("v"), F.lit(0), F.lit(1))
    )
    sums = roles.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return sums.filter((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).isEmpty()
