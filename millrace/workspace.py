"""Where jobs put the files that every executor must be able to read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else one below the warehouse, which
    all executors share as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/millrace"


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder, grouped by application."""
    app = spark.conf.get("spark.app.id", "app")
    return f"{shared_folder(spark)}/{app}/{purpose}-{uuid.uuid4().hex[:12]}"


def job_path(spark: SparkSession, job_id: str, purpose: str) -> str:
    """The path a named job finds again when it is restarted."""
    return f"{shared_folder(spark)}/jobs/{job_id}/{purpose}"


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a path with all below it, in whatever file system it is; says if it was there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh_name(prefix: str) -> str:
    """A database, table or view name that no other run uses."""
    return f"{prefix}_{uuid.uuid4().hex[:10]}"


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """Rows that are needed more than once, written below the shared folder and read back."""
    path = fresh_path(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
