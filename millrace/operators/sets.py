"""INTERSECT, EXCEPT and row comparison through one shuffle of both sides.

Both sides are merged before the shuffle, each task folding equal rows into one. A row
that makes up a third of a side is then no heavier than any other, which a semi or anti
join of the two sides could not promise: Spark moves such a join below a DISTINCT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT = "left_copies", "right_copies"


def row_copies(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every distinct row with its number of copies on each side."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = left.withColumns({LEFT: one, RIGHT: none}).unionByName(right.withColumns({LEFT: none, RIGHT: one}))
    return sides.groupBy(*left.columns).agg(F.sum(LEFT).alias(LEFT), F.sum(RIGHT).alias(RIGHT))


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows whose number of copies differs, repeated rows included."""
    return row_copies(left, right).filter(F.col(LEFT) != F.col(RIGHT))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both sides."""
    return row_copies(left, right).filter(f"{LEFT} > 0 AND {RIGHT} > 0").select(*left.columns)


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the left side that the right side does not have."""
    return row_copies(left, right).filter(f"{LEFT} > 0 AND {RIGHT} = 0").select(*left.columns)
