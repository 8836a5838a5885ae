"""The last value before a row, also when one group holds most of the rows.

Rows are cut into slices by group and order, as for running sums; what a slice ends with is
carried over to the slices after it. Joins of events with what was known at their time are
built on this.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.running import SLICE, slices


def same_slice(keys: Sequence[str], prefix: str) -> Column:
    """Whether a row belongs to the group and slice of a row whose keys carry a prefix."""
    match = [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys]
    return reduce(lambda a, b: a & b, match, F.col(SLICE) == F.col(f"{prefix}{SLICE}"))


def last_before(rows: DataFrame, groups: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Add, for each expression of ``values``, its last value that is not NULL among the
    earlier rows of the group, NULL where there is none.

    ``order`` names columns, ascending and NULLs first, that order the rows of a group
    without ties.
    """
    keys = list(groups)
    cut = slices(rows, keys, [F.col(c).asc() for c in order])
    own = {f"__own_{name}": value for name, value in values.items()}

    # A slice holds parts of at most two groups that reach beyond it, so at most two rows
    # per slice are carried, whatever the data.
    place = F.struct(*order)
    parts = cut.groupBy(*keys, SLICE).agg(*(F.max_by(v, F.when(v.isNotNull(), place)).alias(n) for n, v in own.items()))
    group = Window.partitionBy(*keys)
    before = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        *(F.col(k).alias(f"__of_{k}") for k in (*keys, SLICE)),
        F.count("*").over(group).alias("__slices"),
        *(F.last(n, ignorenulls=True).over(before).alias(f"__before{n}") for n in own),
    ).filter("__slices > 1")

    earlier = Window.partitionBy(SLICE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({n: F.last(v, ignorenulls=True).over(earlier) for n, v in own.items()})
    joined = local.join(F.broadcast(carried), same_slice(keys, "__of_"), "left")
    return joined.select(*rows.columns, *(F.coalesce(f"__own_{n}", f"__before__own_{n}").alias(n) for n in values))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_at: str,
    right_at: str,
    right_tie: str,
    inclusive: bool = True,
) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` that has the same ``by`` columns
    and is not later, as a struct column ``right``; NULL where there is none.

    Both sides go through one range-partitioned pass; neither is broadcast, and a key that
    holds most rows of both is cut into slices like any other.

    * Of right rows at one time the one with the largest ``right_tie`` counts. With
      ``inclusive`` off, right rows at the very time of a left row do not count.
    * Keys that are NULL match each other. A left row without a time matches nothing, and
      a right row without one is matched by nothing.
    * Repeated left rows each come back. Columns of the two sides may share names.
    """
    sides = [
        left.select(
            *(F.col(c).alias(f"__by_{c}") for c in by),
            F.col(left_at).alias("__at"),
            F.lit(1 if inclusive else -1).alias("__side"),
            F.lit(None).cast(right.schema[right_tie].dataType).alias("__tie"),
            F.struct(*left.columns).alias("__left"),
            F.lit(None).cast(right.schema).alias("__right"),
        ),
        right.filter(F.col(right_at).isNotNull()).select(
            *(F.col(c).alias(f"__by_{c}") for c in by),
            F.col(right_at).alias("__at"),
            F.lit(0).alias("__side"),
            F.col(right_tie).alias("__tie"),
            F.lit(None).cast(left.schema).alias("__left"),
            F.struct(*right.columns).alias("__right"),
        ),
    ]
    keys = [f"__by_{c}" for c in by]
    # Left rows that tie come in any order, as none of them is carried to another.
    joined = last_before(sides[0].unionByName(sides[1]), keys, ["__at", "__side", "__tie"], {"right": F.col("__right")})
    found = joined.filter("__left IS NOT NULL")
    timed = F.when(F.col("__at").isNotNull(), F.col("right"))
    return found.select(*(F.col(f"__left.`{c}`") for c in left.columns), timed.alias("right"))
