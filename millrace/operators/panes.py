"""Sliding windows out of panes: what falls between two window starts is summed once, and
windows add up neighbouring panes, so no row is copied into every window that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliding_sums(rows: DataFrame, at: Column, keys: Sequence[str], width: int, slide: int, sums: dict[str, Column]) -> DataFrame:
    """``window_start``, the keys, ``n`` (rows) and the sums for every window ``[start, start +
    width)`` that holds a row; windows start at the multiples of ``slide``.

    ``at``, ``width`` and ``slide`` are whole numbers of one unit, and ``width`` is a multiple
    of ``slide``. Rows are pre-aggregated by pane before the shuffle, and a window reads
    ``width / slide`` rows for each group of keys. Rows without ``at`` are in no window.
    """
    if width % slide:
        raise ValueError("the width of a window must be a multiple of its slide")
    timed = rows.withColumn("__at", at.cast("bigint")).filter(F.col("__at").isNotNull())
    pane = F.col("__at") - F.pmod(F.col("__at"), F.lit(slide))
    panes = timed.groupBy(pane.alias("__pane"), *keys).agg(F.count("*").alias("n"), *(F.sum(v).alias(name) for name, v in sums.items()))
    starts = F.sequence(F.col("__pane") - (width - slide), F.col("__pane"), F.lit(slide).cast("bigint"))
    spread = panes.select(F.explode(starts).alias("window_start"), *keys, "n", *sums)
    return spread.groupBy("window_start", *keys).agg(F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in sums))
