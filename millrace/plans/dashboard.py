"""Dashboard questions on the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import clock
from millrace.functions.money import amount, cents
from millrace.operators.percentiles import exact_percentiles
from millrace.plans.registry import query
from millrace.sources import tables

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
TOP_USERS = 10


def _events(spark: SparkSession, directory: str) -> DataFrame:
    return tables.read(spark, directory, "events")


@query(
    " UNION ALL ".join(
        f"""SELECT '{grain}' AS grain, CAST(date_trunc('{grain}', ts) AS TIMESTAMP) AS bucket, event_type,
       count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY 2, 3 """
        for grain in ("hour", "day", "week", "month")
    )
)
def bi_time_grain(spark: SparkSession, directory: str) -> DataFrame:
    """Count and sum by type at four time grains. The events are read and shuffled once,
    into hours; the coarser grains add hours up."""
    hours = (
        _events(spark, directory)
        .groupBy(clock.hour_of("ts").alias("hour"), "event_type")
        .agg(F.count("*").alias("n_events"), F.sum(cents("value")).alias("total"))
    )
    day = F.col("hour").cast("date")
    starts = {"hour": F.col("hour"), "day": day, "week": F.trunc(day, "week"), "month": F.trunc(day, "month")}
    grains = F.array(
        *(F.struct(F.lit(g).alias("grain"), s.cast("timestamp_ntz").alias("bucket")) for g, s in starts.items())
    )
    return (
        hours.select(F.inline(grains), "event_type", "n_events", "total")
        .groupBy("grain", "bucket", "event_type")
        .agg(F.sum("n_events").alias("n_events"), amount(F.sum("total")).alias("total"))
    )


@query(
    """
SELECT user_id, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY user_id ORDER BY total DESC, user_id LIMIT 10
"""
)
def bi_top_n(spark: SparkSession, directory: str) -> DataFrame:
    """The users with the highest total value; equal totals by user."""
    users = _events(spark, directory).groupBy("user_id").agg(
        F.count("*").alias("n_events"), F.sum(cents("value")).alias("cents")
    )
    top = users.orderBy(F.desc("cents"), "user_id").limit(TOP_USERS)
    return top.select("user_id", "n_events", amount("cents").alias("total"))


@query(
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS \"day\", "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in EVENT_TYPES)
    + f", count(*) FILTER (WHERE (event_type IN {EVENT_TYPES}) IS NOT TRUE) AS other"
    + " FROM events GROUP BY 1"
)
def bi_pivot(spark: SparkSession, directory: str) -> DataFrame:
    """Events by day and type, one column per known type and one for all the rest."""
    known = F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("event_type")).otherwise("other")
    events = _events(spark, directory).select(F.col("ts").cast("date").cast("string").alias("day"), known.alias("kind"))
    return events.groupBy("day").pivot("kind", [*EVENT_TYPES, "other"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def bi_distinct(spark: SparkSession, directory: str) -> DataFrame:
    """Users per type, exactly: pairs are made distinct before they are counted."""
    return _events(spark, directory).groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, true AS within FROM events GROUP BY event_type")
def bi_distinct_approx(spark: SparkSession, directory: str) -> DataFrame:
    """Users per type by sketch, held against the exact number: is the estimate within three
    times the standard error it was asked for? A sketch per type and task is shuffled."""
    events, error = _events(spark, directory), 0.02
    sketched = events.groupBy("event_type").agg(F.approx_count_distinct("user_id", error).alias("estimate"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))
    close = F.abs(F.col("estimate") - F.col("n_users")) <= 3 * error * F.col("n_users")
    same = sketched["event_type"].eqNullSafe(exact["event_type"])
    return exact.join(sketched, same).select(exact["event_type"], "n_users", close.alias("within"))


@query(
    """
SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY event_type
"""
)
def bi_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    wanted = {"p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    found = exact_percentiles(_events(spark, directory), ["event_type"], "value", wanted)
    return found.select("event_type", *(F.round(p, 6).alias(p) for p in wanted))
