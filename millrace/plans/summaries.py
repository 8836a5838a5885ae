"""Answers from what is kept beside the rows: sketches, and a layout by several columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import workspace
from millrace.functions import clock, decode
from millrace.operators import catalog, zorder
from millrace.plans.realtime import EVENT, TOPIC, _events, _messages
from millrace.plans.registry import query
from millrace.sources import topics
from millrace.streaming import ingest, sketches

WANTED = {"p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99}
#: How far an estimate may be off, in standard errors for distinct counts.
DEVIATIONS = 4


@query(
    """
SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", count(*) AS n, count(DISTINCT user_id) AS n_users,
       true AS users_within, true AS quantiles_within
FROM events GROUP BY 1, 2
"""
)
def stream_sketched_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """Users and percentiles of each day and type, merged from the hourly sketches that a
    stream keeps over four parts, none in the order of time, and held against the exact ones:
    is the estimate of users near enough, and is each quantile's true rank?"""
    folder = workspace.fresh_path(spark, "topic")
    for part in (2, 0, 3, 1):
        topics.publish_to_folder(_messages(_events(spark, directory).filter(F.col("event_id") % 4 == part)), folder)
    stream = topics.read_topic(spark, TOPIC, folder=folder, options={"maxFilesPerTrigger": "4"})
    rows = decode.parse_json(stream, EVENT).filter(F.col(decode.CORRUPT).isNull()).select("row.*")
    table = f"{catalog.create_scratch_database(spark, 'sketched')}.hourly"
    ingest.run_to_end(
        sketches.keep_sketches(rows.withColumn("at", clock.instant("ts")), table, workspace.fresh_path(spark, "checkpoint"))
    )
    day = clock.zone_free("hour_start").cast("date")
    parts = sketches.read_sketches(spark, table).withColumn("day", day)
    estimated = workspace.written(sketches.answers(sketches.merged(parts, ["event_type", "day"]), WANTED), "estimates")
    return _held_against(_events(spark, directory), estimated)


def _held_against(events: DataFrame, estimated: DataFrame) -> DataFrame:
    told = estimated.withColumnsRenamed({"event_type": "of_type", "day": "of_day", "n": "kept", "n_users": "users"})
    raw = events.select("event_type", F.col("ts").cast("date").alias("day"), "user_id", F.col("value").cast("double"))
    same = F.col("event_type").eqNullSafe(F.col("of_type")) & F.col("day").eqNullSafe(F.col("of_day"))
    # Ranks are counted per group before anything is compared: rows meet one row per group.
    below = {f"{p}_below": F.count_if(F.col("value") < F.col(p)) for p in WANTED}
    upto = {f"{p}_upto": F.count_if(F.col("value") <= F.col(p)) for p in WANTED}
    ranked = raw.join(told, same, "left").groupBy("event_type", "day").agg(
        F.count("*").alias("n"),
        F.count("value").alias("values"),
        F.count_distinct("user_id").alias("n_users"),
        F.first("users").alias("users"),
        F.first("kept").alias("kept"),
        *(c.alias(name) for name, c in (below | upto).items()),
    )
    slack = 2 * sketches.RANK_ERROR * F.col("values") + 1
    near = F.lit(True)
    for p, rank in WANTED.items():
        at = F.col("values") * rank
        near = near & (F.col(f"{p}_below") <= at + slack) & (F.col(f"{p}_upto") >= at - slack)
    off = F.abs(F.col("users") - F.col("n_users"))
    return ranked.select(
        "event_type",
        F.col("day").cast("string").alias("day"),
        F.col("kept").alias("n"),
        "n_users",
        (off <= DEVIATIONS * sketches.DISTINCT_ERROR * F.col("n_users") + 1).alias("users_within"),
        near.alias("quantiles_within"),
    )


@query(
    """
SELECT 'user' AS filtered_by, count(*) AS n_rows, CAST(coalesce(sum(event_id), 0) AS BIGINT) AS total_event_id
FROM events WHERE user_id BETWEEN 10 AND 19
UNION ALL
SELECT 'time', count(*), CAST(coalesce(sum(event_id), 0) AS BIGINT)
FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00'
UNION ALL
SELECT 'value', count(*), CAST(coalesce(sum(event_id), 0) AS BIGINT) FROM events WHERE value BETWEEN 10 AND 12
UNION ALL
SELECT 'nothing', count(*), CAST(coalesce(sum(event_id), 0) AS BIGINT) FROM events
"""
)
def clustered_filters(spark: SparkSession, directory: str) -> DataFrame:
    """Filters on each of three columns of a table that is laid out by all three."""
    path = workspace.fresh_path(spark, "clustered")
    events = _events(spark, directory)
    zorder.write_clustered(events, path, ["user_id", "ts", "value"], 1_000_000)
    kept = spark.read.schema(events.schema).parquet(path)
    chosen = {
        "user": F.col("user_id").between(10, 19),
        "time": (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")),
        "value": F.col("value").between(10, 12),
        "nothing": F.lit(True),
    }
    found = None
    for name, condition in chosen.items():
        total = F.coalesce(F.sum("event_id"), F.lit(0)).alias("total_event_id")
        one = kept.filter(condition).agg(F.lit(name).alias("filtered_by"), F.count("*").alias("n_rows"), total)
        found = one if found is None else found.unionByName(one)
    return found
