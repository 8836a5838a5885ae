"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS = 1 << 40


def first_by_hash(rows: DataFrame, group: str, key: Column, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of each group, those that come first by a hash of ``key``, with
    their place (``__at``, from 1 on). Rows alike in ``key`` come in any order.

    Groups are counted first, and only rows whose hash lies in the lowest part that is
    expected to hold twice as many as are wanted are numbered, so no task sees a whole
    group. A group of fewer rows than that is taken whole. Null groups are left out.
    """
    hashed = rows.filter(F.col(group).isNotNull()).withColumn("__order", F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(_STEPS)))
    share = F.lit(2.0 * most) / F.col("__count").cast("double")
    counts = hashed.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__count"))
    # A row per group; callers hold a model of every group, so groups are few. Broadcast, the
    # counts reach the rows without dealing these out by group first.
    low = hashed.join(F.broadcast(counts), F.col(group) == F.col("__group")).filter(F.col("__order") < share * float(_STEPS))
    first = Window.partitionBy(group).orderBy("__order", key)
    return low.withColumn("__at", F.row_number().over(first)).filter(F.col("__at") <= most).drop("__order", "__group", "__count")
