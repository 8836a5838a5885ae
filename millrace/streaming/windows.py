"""Windows that a stream closes by a watermark, with the events that came too late for them.

Spark keeps open windows in its state store, writes each window once when the watermark has
passed its end, and drops later events without a word. Here one query writes both: closed
windows, and, as records of their own, the events that Spark no longer counts, so that windows
and late records together hold every event. State is bounded by the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace import workspace
from millrace.operators import catalog
from millrace.streaming.ingest import triggered

#: With several stateful operators allowed, as by default, Spark counts an event as late by
#: the watermark that closed windows in the batch before, and otherwise by its own batch's.
_SEVERAL = "spark.sql.streaming.statefulOperator.allowMultiple"
_MICROS = 1_000_000


def hour_end(at: str = "at") -> Column:
    """The end of an event's hourly window, for ``keep_windows``."""
    seconds = F.unix_seconds(at)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(3600)) + 3600)


def keep_windows(
    events: DataFrame,
    window: Column,
    ends: Column,
    keys: Sequence[str],
    sums: dict[str, Column],
    delay_seconds: int,
    table: str,
    checkpoint: str,
    trigger_seconds: float | None = None,
) -> StreamingQuery:
    """Keep ``n`` and the sums per window and keys of a stream whose event time is the
    TIMESTAMP column ``at``; ``ends`` is the end of the window that an event by itself has,
    without a call of ``window``, which would leave out events without a time.

    ``read_closed`` and ``read_late`` read the table. A window is written when an event at
    least the delay beyond its end has been seen, and one more batch. Events without a time
    are in no window and kept as late ones. A batch that is replayed overwrites what it wrote.
    Table and checkpoint belong together.
    """
    spark = events.sparkSession
    several = spark.conf.get(_SEVERAL, "true") == "true"
    counted = events.withWatermark("at", f"{delay_seconds} seconds").groupBy(window.alias("window"), *keys)
    closed = counted.agg(F.count("*").alias("n"), *(F.sum(v).alias(name) for name, v in sums.items()))
    record = F.struct(*events.columns)
    closed = closed.select(
        F.lit(False).alias("late"),
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *keys,
        "n",
        *sums,
        F.lit(None).cast(events.schema).alias("record"),
    )
    each = events.select(F.lit(True).alias("late"), ends.alias("window_end"), F.col("at").alias("__at"), record.alias("record"))
    both = closed.unionByName(each, allowMissingColumns=True)
    stored = [f for f in closed.schema.fields if f.name != "late"]
    columns = ", ".join(f"{catalog.quoted(f.name)} {f.dataType.simpleString()}" for f in stored)
    options = {"partitionOverwriteMode": "dynamic"}
    catalog.create_table(spark, table, f"{columns}, late boolean, batch bigint", partitioned_by=["late", "batch"], options=options)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # What had been seen when the windows were closed for which an event may be too late.
        seen = _seen(session, checkpoint, batch_id - 2 if several else batch_id - 1)
        passed = F.lit(max(0, seen // 1000 * 1000 - delay_seconds * _MICROS))
        watched = Observation()
        observed = batch.observe(watched, F.max(F.unix_micros("__at")).alias("seen"))
        too_late = F.col("__at").isNull() | (F.unix_micros("window_end") <= passed)
        rows = observed.filter(~F.col("late") | too_late).withColumn("batch", F.lit(batch_id).cast("bigint"))
        rows.select(*(f.name for f in stored), "late", "batch").write.insertInto(table, overwrite=True)
        newest = max(watched.get["seen"] or 0, _seen(session, checkpoint, batch_id - 1))
        session.createDataFrame([(newest,)], "seen bigint").coalesce(1).write.mode("overwrite").parquet(_mark(checkpoint, batch_id))
        workspace.remove(session, _mark(checkpoint, batch_id - 3))

    writer = both.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return triggered(writer, trigger_seconds).start()


def _mark(checkpoint: str, batch_id: int) -> str:
    return f"{checkpoint.rstrip('/')}-seen/batch={batch_id}"


def _seen(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """The newest event time, in microseconds, of all batches up to this one."""
    return spark.read.schema("seen bigint").parquet(_mark(checkpoint, batch_id)).first()[0] if batch_id >= 0 else 0


def read_closed(spark: SparkSession, table: str) -> DataFrame:
    """The windows that are closed, each once."""
    spark.catalog.refreshTable(table)
    return spark.table(table).filter("NOT late").drop("record", "late", "batch")


def read_late(spark: SparkSession, table: str) -> DataFrame:
    """The events that came too late for their windows, as they were."""
    spark.catalog.refreshTable(table)
    return spark.table(table).filter("late").select("record.*")


def keep_pairs(
    left: DataFrame,
    right: DataFrame,
    key: str,
    within_seconds: int,
    delay_seconds: int,
    table: str,
    checkpoint: str,
    how: str = "leftOuter",
    trigger_seconds: float | None = None,
) -> StreamingQuery:
    """Join two streams: rows of ``right`` with the key of a ``left`` row and a time ``at``
    not before its own and at most ``within_seconds`` after it. The table has the struct
    columns ``left`` and ``right``, one of them NULL where an outer join (``how``) finds nothing.

    Both sides are kept in the state store for as long as a partner within the watermarks'
    delay may come; an outer row is written once none can come any more.
    """
    span = f"INTERVAL {within_seconds} SECONDS"
    sides = [
        side.select(F.col(key).alias(f"{name}_key"), F.col("at").alias(f"{name}_at"), F.struct(*side.columns).alias(name)).withWatermark(
            f"{name}_at", f"{delay_seconds} seconds"
        )
        for name, side in (("left", left), ("right", right))
    ]
    met = F.expr(f"left_key = right_key AND right_at >= left_at AND right_at <= left_at + {span}")
    joined = sides[0].join(sides[1], met, how).select("left", "right")
    writer = joined.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return triggered(writer, trigger_seconds).toTable(table)


def ingest_once(
    messages: DataFrame,
    identity: Sequence[str],
    delay_seconds: int,
    table: str,
    checkpoint: str,
    trigger_seconds: float | None = None,
) -> StreamingQuery:
    """Append a topic to a table without the copies that a producer's retries leave: of
    messages alike in ``identity`` whose ``timestamp`` lies within the delay of the first
    one, this stays. What has been seen is kept in the state store for that long."""
    once = messages.withWatermark("timestamp", f"{delay_seconds} seconds").dropDuplicatesWithinWatermark(list(identity))
    writer = once.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return triggered(writer, trigger_seconds).toTable(table)
