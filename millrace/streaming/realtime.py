"""Real-time tables: decoded rows in day partitions, ready for retention.

Every micro-batch owns a sub-partition of each day, named after the query and the batch.
A batch that is replayed after a failure overwrites its own sub-partitions, so its rows
are there once, and whole days can be dropped without a word to the stream. Closed days are
merged by ``compaction``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from concurrent.futures import Future
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.functions import clock, decode
from millrace.operators import catalog, retention
from millrace.schemas import TableSchema
from millrace.streaming import compaction
from millrace.streaming.ingest import triggered

DAY = compaction.DAY
BATCH = compaction.BATCH


def create_realtime_table(
    spark: SparkSession,
    table: str,
    schema: T.StructType,
    segment_rows: int | None = None,
    cluster_by: Sequence[str] = (),
) -> None:
    """A table in day partitions, no file of which holds more than ``segment_rows`` rows.
    Files carry bloom filters for the columns of ``cluster_by``."""
    fields = [*schema.fields, T.StructField(DAY, T.DateType()), T.StructField(BATCH, T.StringType())]
    columns = ", ".join(f"{catalog.quoted(f.name)} {f.dataType.simpleString()}" for f in fields)
    options = {"partitionOverwriteMode": "dynamic"}
    if segment_rows:
        options["maxRecordsPerFile"] = str(segment_rows)
    options |= {f"parquet.bloom.filter.enabled#{column}": "true" for column in cluster_by}
    catalog.create_table(spark, table, columns, "parquet", partitioned_by=(DAY, BATCH), options=options)
    compaction.create_log(spark, table)


def ingest_realtime(
    messages: DataFrame,
    table: str,
    schema: T.StructType,
    day: Column,
    checkpoint: str,
    trigger_seconds: float | None = None,
    cluster_by: Sequence[str] = (),
    defaults: dict[str, Any] | None = None,
    avro_schema: str | None = None,
) -> StreamingQuery:
    """Decode a topic into a real-time table. ``day`` is a row's date by its time column.
    Messages are JSON, or Avro if their schema is given. Values that do not decode go into
    the table's quarantine (``read_quarantined``), for either format.

    A file is closed with its batch, so the trigger interval is the longest time that a
    segment stays open.
    """
    # The query's id is kept in its checkpoint and known once the query has started.
    query_id: Future[str] = Future()

    catalog.create_table(
        messages.sparkSession,
        quarantine_of(table),
        "topic string, `partition` int, `offset` bigint, raw_value binary, batch string",
        partitioned_by=[BATCH],
        options={"partitionOverwriteMode": "dynamic"},
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        own = F.lit(f"{query_id.result()}-{batch_id}")
        parsed = decode.parse_avro(batch, avro_schema) if avro_schema else decode.parse_json(batch, schema)
        # Both tables are written from one parse; a batch that is replayed overwrites both.
        parsed = parsed.persist()
        try:
            rows = parsed.filter(F.col(decode.CORRUPT).isNull()).select("row.*")
            rows = decode.fill_defaults(decode.project(rows, schema), defaults or {})
            rows = rows.withColumn(DAY, day).withColumn(BATCH, own)
            # Small days share a task and a hot day is split over several.
            rows = rows.hint("rebalance", F.col(DAY)).sortWithinPartitions(DAY, *cluster_by)
            rows.write.insertInto(table, overwrite=True)
            broken = parsed.filter(F.col(decode.CORRUPT).isNotNull())
            broken = broken.select("topic", "partition", "offset", F.col("value").alias("raw_value"), own.alias(BATCH))
            broken.write.insertInto(quarantine_of(table), overwrite=True)
        finally:
            parsed.unpersist()

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = triggered(writer, trigger_seconds).start()
    query_id.set_result(query.id)
    return query


def quarantine_of(table: str) -> str:
    """The table that keeps a real-time table's undecodable messages."""
    return f"{table}_quarantine"


def read_quarantined(spark: SparkSession, table: str) -> DataFrame:
    """The messages that did not decode: where they stand in their topic, and their value."""
    spark.catalog.refreshTable(quarantine_of(table))
    return spark.table(quarantine_of(table)).drop(BATCH)


def read_realtime(spark: SparkSession, table: str) -> DataFrame:
    """A real-time table's rows with their day, whether compacted or not. A stream writes from
    a session of its own, so what this session remembers of the table's files is looked up
    anew."""
    spark.catalog.refreshTable(table)
    return compaction.visible(spark, table).drop(BATCH)


def day_by(declared: TableSchema) -> Column:
    """A row's date by the declared time column and unit."""
    if declared.time_unit == "DAYS":
        return clock.day_of(declared.time_column)
    if declared.time_unit == "MILLISECONDS":
        return clock.day_of_millis(declared.time_column)
    raise ValueError(f"time unit {declared.time_unit} is not supported")


def create_declared(spark: SparkSession, table: str, declared: TableSchema) -> None:
    """The real-time table of a declared schema."""
    create_realtime_table(spark, table, declared.struct(), declared.segment_rows, declared.cluster_by)


def ingest_declared(
    messages: DataFrame,
    table: str,
    declared: TableSchema,
    checkpoint: str,
    trigger_seconds: float | None = None,
    message_format: str = "json",
) -> StreamingQuery:
    """Decode a topic by a declared schema: fields, defaults, day and clustering."""
    return ingest_realtime(
        messages,
        table,
        declared.struct(),
        day_by(declared),
        checkpoint,
        trigger_seconds,
        declared.cluster_by,
        declared.defaults(),
        declared.avro() if message_format == "avro" else None,
    )


def expire_declared(spark: SparkSession, table: str, declared: TableSchema, as_of: dt.date) -> int:
    """Drop the days beyond the declared retention; says how many partitions went."""
    if declared.retention_days is None:
        return 0
    return retention.drop_expired(spark, table, DAY, declared.retention_days, as_of)
