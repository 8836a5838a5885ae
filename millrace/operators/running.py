"""Running sums within groups, also when one group holds most of the rows.

The rows are range-partitioned by group and order, which cuts a hot group into slices. Each
slice is summed on its own and then raised by what the slices before it hold. Slices are
kept bucketed, so that summing them does not shuffle the rows a second time. The plan is
the same for any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import workspace
from millrace.operators import catalog

SLICE = "__slice"


def running_total(
    rows: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: dict[str, Column], totals: bool = False
) -> DataFrame:
    """Add the running sum of each expression of ``sums``, and ``<name>_total`` if asked for.

    ``order`` must order the rows of a group without ties. A NULL adds nothing.
    """
    keys = list(groups)
    sums = {name: F.coalesce(value, F.lit(0)) for name, value in sums.items()}
    cut = slices(rows, keys, order)

    # Slices are contiguous, so a slice holds parts of at most two groups that reach
    # beyond it: this table has at most two rows per slice, whatever the data.
    parts = cut.groupBy(*keys, SLICE).agg(*(F.sum(value).alias(name) for name, value in sums.items()))
    group = Window.partitionBy(*keys)
    before = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        *(F.col(g).alias(f"__{g}") for g in keys),
        F.col(SLICE).alias("__of_slice"),
        F.count("*").over(group).alias("__slices"),
        *(F.sum(name).over(before).alias(f"__before_{name}") for name in sums),
        *(F.sum(name).over(group).alias(f"__all_{name}") for name in sums),
    ).filter("__slices > 1")

    local = _add_sums(cut, [SLICE, *keys], order, sums, totals)
    same = F.col(SLICE) == F.col("__of_slice")
    for g in keys:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    joined = local.join(F.broadcast(carried), same, "left")
    raised = {name: F.col(name) + F.coalesce(F.col(f"__before_{name}"), F.lit(0)) for name in sums}
    if totals:
        raised |= {f"{name}_total": F.coalesce(F.col(f"__all_{name}"), F.col(f"{name}_total")) for name in sums}
    return joined.withColumns(raised).select(*rows.columns, *raised)


def slices(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows with their slice (``SLICE``), a task's slice in one bucket. Slices are numbered
    in the order of the keys and of ``order``, and a slice is contiguous in it."""
    spark = rows.sparkSession
    # Slices are written down: range bounds come from a sample, and a lost executor
    # must not make the two reads disagree about them.
    path = workspace.fresh_path(spark, "slices")
    ranged = rows.repartitionByRange(*(F.col(g) for g in keys), *order).withColumn(SLICE, F.spark_partition_id())
    table = f"{catalog.scratch_database(spark)}.{workspace.fresh_name('slices')}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged.write.bucketBy(buckets, SLICE).option("path", path).saveAsTable(table)
    cut = spark.table(table)
    # The frame knows its files; only the name goes.
    spark.sql(f"DROP TABLE {catalog.quoted(table)}")
    return cut


def _add_sums(rows: DataFrame, keys: list[str], order: Sequence[Column], sums: dict[str, Column], totals: bool) -> DataFrame:
    group = Window.partitionBy(*keys)
    upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {name: F.sum(value).over(upto) for name, value in sums.items()}
    if totals:
        added |= {f"{name}_total": F.sum(value).over(group) for name, value in sums.items()}
    return rows.withColumns(added)
