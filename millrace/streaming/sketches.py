"""Distinct users and percentiles per hour and type, kept by a stream as sketches.

Exact distinct counts and percentiles of any span need all its rows again. A sketch per hour
and type is small, and sketches of several hours merge into that of the whole span. As with
hourly sums, each batch has a partition of its own that a replay overwrites, and readers merge
the parts; no event is too late.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import catalog
from millrace.streaming.ingest import triggered

#: Base-two logarithm of the cells of a distinct-count sketch: its standard error is about
#: 1.04 / sqrt(2^LG_K), here 0.016 of the count.
LG_K = 12
#: The size of a quantile sketch; the rank error at 99 % confidence is about 0.013 at 200.
K = 200
RANK_ERROR = 0.0133
DISTINCT_ERROR = 1.04 / 2 ** (LG_K / 2)

_COLUMNS = "hour_start timestamp, event_type string, n bigint, users binary, amounts binary, upto bigint"


def sketched(events: DataFrame) -> DataFrame:
    """Count and sketches per hour and type; ``at`` is the event time (TIMESTAMP). A null, or
    a value that is not finite, is in no sketch."""
    hour = F.window("at", "1 hour")
    amount = F.col("value").cast("double")
    finite = F.when(~F.isnan(amount) & (F.abs(amount) < F.lit(float("inf"))), amount)
    return (
        events.groupBy(hour.alias("hour"), "event_type")
        .agg(
            F.count("*").alias("n"),
            F.hll_sketch_agg("user_id", LG_K).alias("users"),
            F.kll_sketch_agg_double(finite, K).alias("amounts"),
        )
        .select(F.col("hour.start").alias("hour_start"), "event_type", "n", "users", "amounts")
    )


def keep_sketches(events: DataFrame, table: str, checkpoint: str, trigger_seconds: float | None = None) -> StreamingQuery:
    """Keep a table of sketches up to date. Table and checkpoint belong together."""
    catalog.create_table(
        events.sparkSession, table, _COLUMNS, partitioned_by=["upto"], options={"partitionOverwriteMode": "dynamic"}
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        sketched(batch).withColumn("upto", F.lit(batch_id).cast("bigint")).write.insertInto(table, overwrite=True)

    writer = events.writeStream.foreachBatch(write)
    return triggered(writer.option("checkpointLocation", checkpoint), trigger_seconds).start()


def read_sketches(spark: SparkSession, table: str) -> DataFrame:
    """The parts as they are; filter them by hour before they are merged."""
    spark.catalog.refreshTable(table)
    return spark.table(table).drop("upto")


def merged(parts: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Sketches of the same group made one. Sketches are combined in each task first, so a
    hot group is shuffled as one sketch a task."""
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("users").alias("users"),
        F.kll_merge_agg_double("amounts").alias("amounts"),
    )


def answers(found: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """Estimated users, and the value at each rank of ``wanted`` (null where there are no
    values), in place of the sketches."""
    some = F.kll_sketch_get_n_double("amounts") > 0
    quantiles = {name: F.when(some, F.kll_sketch_get_quantile_double("amounts", F.lit(rank))) for name, rank in wanted.items()}
    return found.withColumns({"n_users": F.hll_sketch_estimate("users"), **quantiles}).drop("users", "amounts")
