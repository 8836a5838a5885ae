"""SQL given as text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, text: str, args: dict[str, Any] | None = None, **frames: DataFrame) -> DataFrame:
    """Run SQL text. ``args`` fill ``:name`` markers as values, never as text;
    ``frames`` fill ``{name}`` with DataFrames."""
    return spark.sql(text, args=args, **frames)
