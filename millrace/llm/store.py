"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace import workspace


def written(rows: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """Write ``rows`` as Parquet below the shared folder and read them back. ``compression``
    is the session's unless another one is named.

    This cuts the lineage: a lost executor costs the tasks that it ran, not the work
    that led here, and what is read twice is computed once.
    """
    spark = rows.sparkSession
    path = workspace.fresh_path(spark, purpose)
    rows.write.parquet(path, compression=compression)
    return spark.read.schema(rows.schema).parquet(path)
