"""Metrics per hour and type, the same whether computed in batch or kept by a stream.

The stream keeps a table of partial sums: each batch adds what its own events amount to, in
a partition of its own, and readers add the parts up. No event is too late, no state is
kept, and a batch that is replayed overwrites its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions import clock
from millrace.functions.money import cents
from millrace.operators import catalog
from millrace.streaming.ingest import triggered

_COLUMNS = "hour_start timestamp, event_type string, n bigint, cents decimal(28,0), merged boolean, upto bigint"


def hourly_metrics(events: DataFrame) -> DataFrame:
    """Count and exact sum per hour and type; ``at`` is the event time (TIMESTAMP)."""
    hour = F.window("at", "1 hour")
    return (
        events.groupBy(hour.alias("hour"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(cents("value")).alias("cents"))
        .select(F.col("hour.start").alias("hour_start"), "event_type", "n", "cents")
    )


def keep_hourly_metrics(
    events: DataFrame, table: str, checkpoint: str, trigger_seconds: float | None = None
) -> StreamingQuery:
    """Keep a table of hourly metrics up to date. Table and checkpoint belong together."""
    catalog.create_table(
        events.sparkSession,
        table,
        _COLUMNS,
        partitioned_by=["merged", "upto"],
        options={"partitionOverwriteMode": "dynamic"},
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        parts = hourly_metrics(batch).withColumns({"merged": F.lit(False), "upto": F.lit(batch_id).cast("bigint")})
        parts.write.insertInto(table, overwrite=True)

    writer = events.writeStream.foreachBatch(write)
    return triggered(writer.option("checkpointLocation", checkpoint), trigger_seconds).start()


def _counting(spark: SparkSession, table: str) -> DataFrame:
    """The parts that count: the newest merged ones, and those of later batches. A merge
    counts from the moment its partition is there, and what it replaces no longer does."""
    name = catalog.quoted(table)
    newest = f"coalesce((SELECT max(upto) FROM {name} WHERE merged), -1)"
    return spark.sql(f"SELECT * FROM {name} WHERE (merged AND upto = {newest}) OR (NOT merged AND upto > {newest})")


def _added_up(parts: DataFrame) -> DataFrame:
    total = F.sum("cents").cast("decimal(28,0)")
    return parts.groupBy("hour_start", "event_type").agg(F.sum("n").alias("n"), total.alias("cents"))


def read_hourly_metrics(spark: SparkSession, table: str) -> DataFrame:
    """Every hour's figures."""
    spark.catalog.refreshTable(table)
    return _added_up(_counting(spark, table))


def merge_parts(spark: SparkSession, table: str) -> int:
    """Add the parts written so far up into one partition; says how many went. Readers see
    the same figures before, during and after, and a running stream is not disturbed."""
    # Partition names only, one per batch since the last merge.
    listed = spark.sql(f"SHOW PARTITIONS {catalog.quoted(table)}").toLocalIterator()
    specs = [dict(part.split("=", 1) for part in row.partition.split("/")) for row in listed]
    upto = max((int(s["upto"]) for s in specs if s["merged"] == "false"), default=None)
    if upto is None:
        return 0
    spark.catalog.refreshTable(table)
    merged = _added_up(_counting(spark, table).filter(F.col("upto") <= upto))
    merged = merged.withColumns({"merged": F.lit(True), "upto": F.lit(upto).cast("bigint")})
    merged.write.insertInto(table, overwrite=True)
    replaced = [s for s in specs if int(s["upto"]) <= upto and s != {"merged": "true", "upto": str(upto)}]
    catalog.drop_partitions(spark, table, replaced)
    return len(replaced)


def presentable(metrics: DataFrame) -> DataFrame:
    """Hours as zone-free timestamps and sums as plain numbers."""
    return metrics.select(
        clock.zone_free("hour_start").alias("hour_start"),
        "event_type",
        "n",
        (F.col("cents").cast("double") / 100.0).alias("total"),
    )
