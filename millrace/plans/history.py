"""Summaries of event logs.

The registered queries read logs that Spark derives from ``events``, so that they grow
with it: an application per event type, a stage per day, and a task per event that ran
a millisecond for each cent of its value. Logs of real applications are read in tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import workspace
from millrace.functions import clock
from millrace.operators import joblog
from millrace.plans.registry import query
from millrace.sources import eventlog, tables


def _line(**fields: Column) -> Column:
    return F.to_json(F.struct(*(value.alias(name.replace("_", " ")) for name, value in fields.items())))


def _derived_log(spark: SparkSession, directory: str) -> DataFrame:
    events = tables.read(spark, directory, "events")
    app = F.concat(F.lit("app-"), F.col("event_type"))
    launch = clock.epoch_millis("ts")
    run_time = F.rint(F.col("value") * 100).cast("bigint")

    task_info = F.struct(
        F.col("event_id").alias("Task ID"),
        launch.alias("Launch Time"),
        (launch + run_time).alias("Finish Time"),
        (F.col("user_id") % 10 == 0).alias("Failed"),
        F.lit(False).alias("Killed"),
    )
    metrics = F.struct(
        run_time.alias("Executor Run Time"),
        (F.col("event_id") % 3).alias("Memory Bytes Spilled"),
        (F.col("event_id") % 5).alias("Disk Bytes Spilled"),
        F.struct(F.col("user_id").alias("Remote Bytes Read"), F.lit(1).cast("bigint").alias("Local Bytes Read")).alias(
            "Shuffle Read Metrics"
        ),
        F.struct((F.col("user_id") * 2).alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics"),
    )
    tasks = events.select(
        app.alias("app"),
        _line(
            Event=F.lit("SparkListenerTaskEnd"),
            Stage_ID=clock.epoch_days("ts").cast("bigint"),
            Stage_Attempt_ID=F.lit(0).cast("bigint"),
            Task_Info=task_info,
            Task_Metrics=metrics,
        ).alias("line"),
    )
    spans = events.groupBy(app.alias("app"), F.col("event_type")).agg(
        F.min(launch).alias("start"), F.max(launch).alias("end")
    )
    starts = spans.select(
        "app",
        _line(
            Event=F.lit("SparkListenerApplicationStart"),
            App_Name=F.col("event_type"),
            App_ID=F.col("app"),
            Timestamp=F.col("start"),
        ).alias("line"),
    )
    # The 'error' application never ends, like one that was killed.
    ends = spans.filter("event_type <> 'error'").select(
        "app", _line(Event=F.lit("SparkListenerApplicationEnd"), Timestamp=F.col("end")).alias("line")
    )
    folder = workspace.fresh_path(spark, "event-log")
    for lines in (tasks, starts.unionByName(ends)):
        lines.write.mode("append").partitionBy("app").text(folder)
    return eventlog.read_event_log(spark, folder)


@query(
    """
SELECT 'app-' || event_type AS app, event_type AS name, epoch_us(min(ts)) // 1000 AS started,
       CASE WHEN event_type <> 'error' THEN epoch_us(max(ts)) // 1000 END AS ended,
       CASE WHEN event_type <> 'error' THEN (epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000) END AS duration_ms,
       event_type <> 'error' AS finished
FROM events GROUP BY event_type
"""
)
def history_applications(spark: SparkSession, directory: str) -> DataFrame:
    return joblog.applications(_derived_log(spark, directory))


@query(
    """
SELECT 'app-' || event_type AS app, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS stage,
       count(*) AS n_tasks, CAST(sum(CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS run_ms,
       CAST(sum(user_id + 1) AS BIGINT) AS shuffle_read_bytes,
       CAST(sum(user_id * 2) AS BIGINT) AS shuffle_write_bytes,
       CAST(sum(event_id % 3 + event_id % 5) AS BIGINT) AS spilled_bytes
FROM events GROUP BY 1, 2
"""
)
def history_stage_summary(spark: SparkSession, directory: str) -> DataFrame:
    return joblog.stages(_derived_log(spark, directory))


@query(
    """
SELECT app, stage, n_tasks, longest_ms, median_ms,
       CASE WHEN median_ms > 0 THEN round(longest_ms / median_ms, 6) END AS skew
FROM (SELECT 'app-' || event_type AS app, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS stage,
             count(*) AS n_tasks, max(CAST(round(value * 100) AS BIGINT)) AS longest_ms,
             quantile_cont(CAST(round(value * 100) AS BIGINT), 0.5) AS median_ms
      FROM events GROUP BY 1, 2)
"""
)
def history_task_skew(spark: SparkSession, directory: str) -> DataFrame:
    return joblog.task_skew(_derived_log(spark, directory))
