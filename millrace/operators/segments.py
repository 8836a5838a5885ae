"""Segments: a real-time table's rows in arrival order, at most N to a segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import running


def assign_segments(rows: DataFrame, partition_cols: Sequence[str], order_col: str, max_rows: int) -> DataFrame:
    """Add ``segment``, counted from 0 within each partition. ``order_col`` is the
    arrival order and has no ties."""
    numbered = running.running_total(rows, partition_cols, [F.col(order_col).asc()], {"__row": F.lit(1)})
    number = F.floor((F.col("__row") - 1) / F.lit(max_rows)).cast("bigint")
    return numbered.withColumn("segment", number).drop("__row")


def write_segments(rows: DataFrame, path: str, day_col: str, max_rows: int, cluster_by: Sequence[str] = ()) -> None:
    """Write rows into day folders, no file above N rows, sorted within each task by the
    columns that queries filter on, so that Parquet statistics and bloom filters skip files."""
    # Rebalancing by day merges small days into whole tasks and splits a hot day.
    spread = rows.hint("rebalance", F.col(day_col))
    writer = (
        spread.sortWithinPartitions(day_col, *cluster_by)
        .write.mode("append")
        .partitionBy(day_col)
        .option("maxRecordsPerFile", max_rows)
    )
    for column in cluster_by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
