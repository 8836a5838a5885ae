"""The benchmark directory: one Parquet table per name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
ACTIVITY_TABLES = ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
ALL_TABLES = STAR_TABLES + ACTIVITY_TABLES


def location(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/{name}.parquet"


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(location(directory, name))


def register_views(spark: SparkSession, directory: str, names: Iterable[str] = ALL_TABLES, prefix: str = "") -> dict[str, str]:
    """Make the tables of a directory visible to SQL text; each table's view. A prefix keeps
    them apart from views of the session that have the tables' names."""
    views = {name: f"{prefix}{name}" for name in names}
    for name, view in views.items():
        read(spark, directory, name).createOrReplaceTempView(view)
    return views


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A producer's input files. ``avro`` needs Spark's Avro package, which raises Spark's
    own error where it is missing."""
    return spark.read.format(fmt).load(path)
