"""Joins of intervals that overlap, without comparing all with all.

Keys with few intervals are compared whole, so that each interval is sent once, however
long it is. For the others time is cut into bins. An interval is put into each bin that it
touches, intervals that share a key and a bin meet, and a pair is returned in the first bin
that both touch, so once. Bins in which very many would meet are split: the left side is
dealt into parts, and each part meets the whole right side of its bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import workspace

#: Intervals of a key, of both sides together, that are compared without bins.
WHOLE = 200
#: Left intervals of a bin that meet the right ones in one task, about.
PART = 10_000


def overlapping(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    bin_width: int,
    part: int = PART,
    whole: int = WHOLE,
) -> DataFrame:
    """Pairs of a left and a right row with the same ``by`` columns whose half-open spans
    ``[from, to)`` overlap, as struct columns ``left`` and ``right``.

    Spans are whole numbers, such as epoch seconds or days, and ``bin_width`` is about the
    length of the shorter ones: wider bins bring together more that do not overlap, narrower
    ones repeat long spans.

    * Spans that are empty, reversed or have a NULL end overlap nothing, and a NULL key
      matches nothing. Repeated rows are pairs of their own.
    * Both sides are read twice, first to count the intervals of each key, so a costly side
      is to be written down before.
    * Nothing is broadcast by hand. Keys with more than ``whole`` intervals and bins with
      more than ``part`` left ones are written down when the join is built, so that Spark
      knows how few they are; a bin that holds most rows is split by that count.
    """
    keys = [f"__by_{c}" for c in by] or ["__by"]
    a, b = _usable(left, by, left_span, "left"), _usable(right, by, right_span, "right")
    each = a.select(*keys).unionAll(b.select(*keys))
    large = workspace.written(_crowded(each, keys, whole).select(*keys, F.lit(True).alias("__large")), "large-keys")
    a, b = _binned(a.join(large, keys, "left"), bin_width, "left"), _binned(b.join(large, keys, "left"), bin_width, "right")
    crowded = _crowded(a.filter("__large"), [*keys, "__bin"], part)
    crowded = workspace.written(crowded.select(*keys, "__bin", F.ceil(F.col("__many") / part).cast("int").alias("__parts")), "crowded-bins")
    parts = F.coalesce("__parts", F.lit(1))
    # Rows of a crowded bin stand on both sides of a scan, which adaptive execution can split.
    dealt_a = a.join(crowded, [*keys, "__bin"], "left").withColumn("__part", F.pmod(F.xxhash64("left"), parts).cast("int"))
    dealt_b = b.join(crowded, [*keys, "__bin"], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = dealt_a.drop("__parts", "__large").join(dealt_b.drop("__parts", "__large"), [*keys, "__bin", "__part"])
    overlap = (F.col("__left_from") < F.col("__right_to")) & (F.col("__right_from") < F.col("__left_to"))
    once = F.col("__bin") == F.greatest("__left_first", "__right_first")
    return met.filter(overlap & once).select("left", "right")


def _usable(rows: DataFrame, by: Sequence[str], span: tuple[str, str], side: str) -> DataFrame:
    start, end = F.col(span[0]).cast("bigint"), F.col(span[1]).cast("bigint")
    usable = rows.filter(start < end)
    for c in by:
        usable = usable.filter(F.col(c).isNotNull())
    keys = [F.col(c).alias(f"__by_{c}") for c in by] or [F.lit(0).alias("__by")]
    return usable.select(*keys, start.alias(f"__{side}_from"), end.alias(f"__{side}_to"), F.struct(*rows.columns).alias(side))


def _crowded(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The keys of more rows than ``limit``, and their number of rows as ``__many``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("__many")).filter(F.col("__many") > limit)


def _binned(rows: DataFrame, width: int, side: str) -> DataFrame:
    """Intervals of large keys in each bin that they touch, all others in bin 0."""

    def bin_of(value: Column) -> Column:
        number = ((value - F.pmod(value, F.lit(width))) / width).cast("bigint")
        return F.when(F.col("__large"), number).otherwise(F.lit(0).cast("bigint"))

    first, last = bin_of(F.col(f"__{side}_from")), bin_of(F.col(f"__{side}_to") - 1)
    return rows.withColumns({f"__{side}_first": first, "__bin": F.explode(F.sequence(first, last))})
