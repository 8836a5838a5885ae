"""Databases and tables: create, append, reset, list."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from millrace import workspace
from millrace.sources import tables

_PER_STATEMENT = 500


def quoted(name: str) -> str:
    """A one- to three-part name with each part quoted."""
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def list_databases(spark: SparkSession, like: str | None = None) -> DataFrame:
    """One row (``namespace``) per database, optionally those matching a ``*`` pattern."""
    return spark.sql("SHOW DATABASES" + (f" LIKE {_literal(like)}" if like else ""))


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    at = f" LOCATION {_literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)}{at}")


def create_scratch_database(spark: SparkSession, prefix: str) -> str:
    """A database of its own for one run, below the shared folder."""
    database = f"{_scratch_prefix(spark)}_{workspace.fresh_name(prefix)}"
    create_database(spark, database, workspace.fresh_path(spark, database))
    return database


def scratch_database(spark: SparkSession) -> str:
    """The application's one database for tables that only have a name for a moment."""
    database = _scratch_prefix(spark)
    create_database(spark, database, f"{workspace.shared_folder(spark)}/{database}")
    return database


def drop_scratch(spark: SparkSession) -> int:
    """Remove all scratch databases of this application with their tables and files; says
    how many went. Results that still read from them must be finished."""
    names = [row.namespace for row in list_databases(spark, f"{_scratch_prefix(spark)}*").toLocalIterator()]
    for name in names:
        reset_database(spark, name)
    return len(names)


def _scratch_prefix(spark: SparkSession) -> str:
    return "scratch_" + re.sub(r"[^a-z0-9]+", "_", spark.sparkContext.applicationId.lower())


def create_table(
    spark: SparkSession,
    table: str,
    columns: str,
    fmt: str = "parquet",
    partitioned_by: Iterable[str] = (),
    options: dict[str, str] | None = None,
    location: str | None = None,
) -> None:
    """Create a typed table if it is missing. ``table`` may have a catalog part, and
    ``fmt`` is any format that the catalog knows."""
    statement = f"CREATE TABLE IF NOT EXISTS {quoted(table)}"
    if columns:
        statement += f" ({columns})"
    statement += f" USING {fmt}"
    if options:
        statement += " OPTIONS (" + ", ".join(f"{_literal(k)} {_literal(v)}" for k, v in options.items()) + ")"
    if partitioned := ", ".join(quoted(c) for c in partitioned_by):
        statement += f" PARTITIONED BY ({partitioned})"
    if location:
        statement += f" LOCATION {_literal(location)}"
    spark.sql(statement)


def append(spark: SparkSession, table: str, view: str) -> None:
    """Append a view's rows by column position. Running it again appends them again."""
    spark.sql(f"INSERT INTO {quoted(table)} SELECT * FROM {quoted(view)}")


def append_rows(spark: SparkSession, table: str, rows: DataFrame) -> None:
    """``append`` for a DataFrame, through a session view of its own."""
    view = workspace.fresh_name("rows")
    rows.createOrReplaceTempView(view)
    try:
        append(spark, table, view)
    finally:
        spark.catalog.dropTempView(view)


def reset_table(spark: SparkSession, table: str) -> None:
    """Remove a table's rows and keep its definition."""
    spark.sql(f"TRUNCATE TABLE {quoted(table)}")


def reset_ingested(spark: SparkSession, table: str, checkpoint: str, name: str | None = None) -> None:
    """Take back everything a streaming job has done: stop it if it runs here, and remove
    table, files and sink log together with the checkpoint. Run again, the job reads its
    topic from the start. ``reset_table`` alone would leave a checkpoint that believes the
    rows are there, and a table whose sink log is gone."""
    for query in spark.streams.active:
        if query.name == name and name is not None:
            query.stop()
    where = None
    if spark.catalog.tableExists(table):
        described = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)}").filter("col_name = 'Location'").first()
        where = described.data_type if described else None
    spark.sql(f"DROP TABLE IF EXISTS {quoted(table)}")
    for path in (where, checkpoint):
        if path:
            workspace.remove(spark, path)


def reset_database(spark: SparkSession, database: str) -> None:
    """Remove a database with the tables and files it manages."""
    spark.sql(f"DROP DATABASE IF EXISTS {quoted(database)} CASCADE")


def drop_partitions(spark: SparkSession, table: str, specs: list[dict[str, str | None]]) -> None:
    """Drop whole partitions with their files, a few hundred to a statement. None stands for
    the partition of rows without a value."""
    for start in range(0, len(specs), _PER_STATEMENT):
        clauses = ", ".join(
            "PARTITION (" + ", ".join(f"{quoted(column)} = {'NULL' if value is None else _literal(value)}" for column, value in spec.items()) + ")"
            for spec in specs[start : start + _PER_STATEMENT]
        )
        spark.sql(f"ALTER TABLE {quoted(table)} DROP IF EXISTS {clauses}")


def register_dataset(spark: SparkSession, directory: str, database: str, names: Iterable[str] = tables.ALL_TABLES) -> None:
    """Make the tables of a benchmark directory part of a database, in place."""
    for name in names:
        create_table(spark, f"{database}.{name}", "", location=tables.location(directory, name))
