"""Row numbers within groups of any size, by DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a row's hash that name its cell: 4,096 cells to a stratum.
CELL_DIGITS = 3


def with_hash(rows: DataFrame, key: Column, name: str = "__hash") -> DataFrame:
    """Add the MD5 of a key, which orders rows evenly and alike in every engine."""
    return rows.withColumn(name, F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")))


def numbered(
    rows: DataFrame,
    counted: DataFrame,
    group: str,
    strata: Sequence[str],
    order: Sequence[Column],
    name: str,
    known: DataFrame | None = None,
) -> DataFrame:
    """Add ``name``: each row's number within its group, from 1 on and without gaps, in the
    order of the strata, then of ``__hash``, then of ``order``.

    ``counted`` has the same rows as ``rows``, with the columns named here at least; it is
    read for counts alone. A group is cut into cells by stratum and by the beginning of the
    hash, which deals out a group of any size. Cells are counted, a running count over the
    cells of a group (4,096 to a stratum at most) says how many rows come before each, and
    rows are numbered within their cells. Null groups and strata come first, in a group of
    their own. ``known``, with a row per group, adds its other columns to the group's rows;
    they come with the counts, so rows are never dealt out by group.
    """
    prefix = F.substring("__hash", 1, CELL_DIGITS)
    # One key that is never null: rows are shuffled by it once, for numbering and for the join.
    cell = F.to_json(F.struct(F.col(group), *strata, prefix.alias("cell")), {"ignoreNullFields": "false"})
    keys = [group, *strata, "__prefix"]
    counts = counted.withColumns({"__cell": cell, "__prefix": prefix}).groupBy("__cell", *keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy(*(F.col(c).asc_nulls_first() for c in (*strata, "__prefix")))
    placed = counts.withColumn("__before", F.sum("__n").over(before) - F.col("__n"))
    extra = []
    if known is not None:
        extra = [c for c in known.columns if c != group]
        named = known.withColumnRenamed(group, "__known")
        placed = placed.join(named, F.col(group).eqNullSafe(F.col("__known")), "left")
    own = Window.partitionBy("__cell").orderBy("__hash", *order)
    within = rows.withColumn("__cell", cell).withColumn("__own", F.row_number().over(own))
    joined = within.join(placed.select("__cell", "__before", *extra), "__cell")
    return joined.withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__cell", "__own", "__before")
