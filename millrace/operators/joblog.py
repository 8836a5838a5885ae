"""What event logs say about applications, stages and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.percentiles import exact_percentiles


def applications(events: DataFrame) -> DataFrame:
    """Each application's name, start, end (epoch ms), duration, and whether it finished."""
    kind = F.col("Event")
    start, end = kind == "SparkListenerApplicationStart", kind == "SparkListenerApplicationEnd"
    marks = events.filter(start | end).groupBy("app").agg(
        F.max(F.when(start, F.col("App Name"))).alias("name"),
        F.min(F.when(start, F.col("Timestamp"))).alias("started"),
        F.max(F.when(end, F.col("Timestamp"))).alias("ended"),
    )
    return marks.select(
        "app",
        "name",
        "started",
        "ended",
        (F.col("ended") - F.col("started")).alias("duration_ms"),
        F.col("ended").isNotNull().alias("finished"),
    )


def tasks(events: DataFrame) -> DataFrame:
    """One row per finished task attempt."""

    def metric(path: str) -> Column:
        return F.coalesce(F.col(f"Task Metrics.{path}"), F.lit(0))

    return events.filter(F.col("Event") == "SparkListenerTaskEnd").select(
        "app",
        F.col("Stage ID").alias("stage"),
        (F.col("Task Info.Failed") | F.col("Task Info.Killed")).alias("failed"),
        (F.col("Task Info.Finish Time") - F.col("Task Info.Launch Time")).alias("took_ms"),
        metric("Executor Run Time").alias("run_ms"),
        (metric("Shuffle Read Metrics.Remote Bytes Read") + metric("Shuffle Read Metrics.Local Bytes Read")).alias(
            "read_bytes"
        ),
        metric("Shuffle Write Metrics.Shuffle Bytes Written").alias("write_bytes"),
        (metric("Memory Bytes Spilled") + metric("Disk Bytes Spilled")).alias("spilled"),
    )


def stages(events: DataFrame) -> DataFrame:
    """Tasks, failures, run time, shuffle and spill of each stage."""
    return tasks(events).groupBy("app", "stage").agg(
        F.count("*").alias("n_tasks"),
        F.count_if("failed").alias("n_failed"),
        F.sum("run_ms").alias("run_ms"),
        F.sum("read_bytes").alias("shuffle_read_bytes"),
        F.sum("write_bytes").alias("shuffle_write_bytes"),
        F.sum("spilled").alias("spilled_bytes"),
    )


def task_skew(events: DataFrame) -> DataFrame:
    """The longest against the median task of each stage."""
    taken = tasks(events).select("app", "stage", "took_ms")
    wanted = {"median_ms": 0.5, "longest": 1.0}
    times = exact_percentiles(taken, ["app", "stage"], "took_ms", wanted, count_as="n_tasks")
    skew = F.when(F.col("median_ms") > 0, F.round(F.col("longest") / F.col("median_ms"), 6))
    return times.select(
        "app", "stage", "n_tasks", F.col("longest").cast("bigint").alias("longest_ms"), "median_ms", skew.alias("skew")
    )
