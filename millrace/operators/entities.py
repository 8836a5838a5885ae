"""Wide rows about one entity, gathered from its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import clock, decode
from millrace.schemas import MERGED_CHANGES

# Each list of a merged change beside the metric that counts it.
LIST_COUNTS = {
    "authors": "numAuthors",
    "committers": "numCommitters",
    "reviewers": "numReviewers",
    "commenters": "numCommenters",
}


def value_set(column: str | Column) -> Column:
    """The distinct values of a column of few values (a type, a role, a label), sorted."""
    return F.sort_array(F.collect_set(column))


def with_derived_fields(rows: DataFrame) -> DataFrame:
    """Add what follows from other fields: distinct members of the lists that rows have, and
    the time from creation to merge."""
    counts = {
        metric: F.array_size(F.array_distinct(members)).cast("bigint")
        for members, metric in LIST_COUNTS.items()
        if members in rows.columns
    }
    elapsed = F.col("mergedTimeMillis") - F.col("createdTimeMillis")
    return rows.withColumns({**counts, "elapsedTimeMillis": elapsed})


def merged_changes(events: DataFrame) -> DataFrame:
    """One merged-change row per user: its event types as labels and as authors, its number
    of events, its first and last event as creation and merge, and what follows from them."""
    gathered = events.groupBy(F.col("user_id").cast("string").alias("userId")).agg(
        value_set("event_type").alias("labels"),
        F.count("*").alias("count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    wide = gathered.select(
        "userId",
        "labels",
        F.col("labels").alias("authors"),
        "count",
        clock.epoch_millis("first_ts").alias("createdTimeMillis"),
        clock.epoch_millis("last_ts").alias("mergedTimeMillis"),
    )
    declared = decode.project(with_derived_fields(wide), MERGED_CHANGES.struct())
    return decode.fill_defaults(declared, MERGED_CHANGES.defaults())


def count_members(rows: DataFrame, list_col: str, **counts: Column) -> DataFrame:
    """Aggregates over the rows that have each value (``member``) in their multi-valued column."""
    flat = rows.withColumn("member", F.explode(F.array_distinct(list_col)))
    return flat.groupBy("member").agg(*(count.alias(name) for name, count in counts.items()))
