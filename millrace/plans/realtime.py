"""Topics, decoding, and real-time tables over the given events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import workspace
from millrace.functions import clock, decode
from millrace.functions.money import amount, cents
from millrace.operators import catalog, entities, retention, segments, sets
from millrace.plans.registry import query
from millrace.schemas import FLIGHTS, MERGED_CHANGES
from millrace.sources import tables, topics
from millrace.streaming import compaction, hourly, ingest, realtime

TOPIC = "events"
TOPIC_PARTITIONS = 2

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

_EVENTS_SQL = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


def _events(spark: SparkSession, directory: str) -> DataFrame:
    return tables.read(spark, directory, "events")


def _messages(events: DataFrame, value: Column | None = None) -> DataFrame:
    """Events as topic records: the user as key, the row as JSON."""
    return topics.records(
        events,
        TOPIC,
        key=F.col("user_id"),
        value=decode.encode_json("*") if value is None else value,
        offset=F.col("event_id"),
        timestamp=clock.instant("ts"),
        partitions=TOPIC_PARTITIONS,
    )


def _published(spark: SparkSession, messages: DataFrame) -> str:
    folder = workspace.fresh_path(spark, "topic")
    topics.publish_to_folder(messages, folder)
    return folder


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return topics.read_topic(spark, TOPIC, folder=folder)


def _replay(spark: SparkSession, folder: str) -> DataFrame:
    return topics.read_topic(spark, TOPIC, folder=folder, streaming=False)


@query(
    """
SELECT CAST(user_id AS VARCHAR) AS "key", count(*) AS n_messages, CAST(sum(event_id) AS BIGINT) AS total_event_id
FROM events GROUP BY user_id
"""
)
def topic_publish_json(spark: SparkSession, directory: str) -> DataFrame:
    folder = _published(spark, _messages(_events(spark, directory)))
    event_id = F.get_json_object(F.col("value").cast("string"), "$.event_id").cast("bigint")
    return (
        _replay(spark, folder)
        .groupBy(F.col("key").cast("string").alias("key"))
        .agg(F.count("*").alias("n_messages"), F.sum(event_id).alias("total_event_id"))
    )


@query(_EVENTS_SQL)
def decode_json(spark: SparkSession, directory: str) -> DataFrame:
    folder = _published(spark, _messages(_events(spark, directory)))
    good, _ = decode.decode_json(_replay(spark, folder), EVENT)
    return good


@query(_EVENTS_SQL)
def ingest_topic_append(spark: SparkSession, directory: str) -> DataFrame:
    folder = _published(spark, _messages(_events(spark, directory)))
    table = f"{catalog.create_scratch_database(spark, 'ingestion')}.{TOPIC}"
    checkpoint = workspace.fresh_path(spark, "checkpoint")
    ingest.run_to_end(ingest.ingest_topic(_stream(spark, folder), table, checkpoint, schema=EVENT))
    return spark.table(table).select(*EVENT.names)


@query("SELECT event_type, count(*) AS n_events, CAST(sum(event_id) AS BIGINT) AS total_event_id FROM events GROUP BY event_type")
def ingest_reset_reload(spark: SparkSession, directory: str) -> DataFrame:
    """A job that ran, was taken back with all it did, and ran again: each event is there once."""
    folder = _published(spark, _messages(_events(spark, directory)))
    job = workspace.fresh_name("ingestion")
    table = f"{catalog.create_scratch_database(spark, 'reset')}.{TOPIC}"
    checkpoint = workspace.job_path(spark, job, "checkpoint")
    for run in range(2):
        if run:
            catalog.reset_ingested(spark, table, checkpoint, job)
        ingest.run_to_end(ingest.ingest_topic(_stream(spark, folder), table, checkpoint, schema=EVENT, name=job))
    spark.catalog.refreshTable(table)
    kept = spark.table(table).groupBy("event_type")
    return kept.agg(F.count("*").alias("n_events"), F.sum("event_id").alias("total_event_id"))


@query("SELECT event_type, count(*) AS n_events FROM events GROUP BY event_type")
def ingest_restart(spark: SparkSession, directory: str) -> DataFrame:
    """The same named job run twice: the second run finds nothing left to do."""
    folder = _published(spark, _messages(_events(spark, directory)))
    job = workspace.fresh_name("ingestion")
    table = f"{catalog.create_scratch_database(spark, 'restart')}.{TOPIC}"
    checkpoint = workspace.job_path(spark, job, "checkpoint")
    for _ in range(2):
        ingest.run_to_end(ingest.ingest_topic(_stream(spark, folder), table, checkpoint, schema=EVENT, name=job))
    return spark.table(table).groupBy("event_type").agg(F.count("*").alias("n_events"))


@query(
    """
SELECT CAST(user_id AS VARCHAR) AS "key", event_type AS "value" FROM events
UNION ALL
SELECT CAST(event_id AS VARCHAR), props FROM events
"""
)
def envelope_explode(spark: SparkSession, directory: str) -> DataFrame:
    """Every event posted as an envelope of two records, and the records taken out."""
    record = lambda key, value: F.struct(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))
    records = F.array(record("user_id", "event_type"), record("event_id", "props"))
    bodies = _events(spark, directory).select(F.to_json(F.struct(records.alias("records"))).alias("body"))
    return decode.explode_envelope(bodies)


@query(
    """
SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type END, '') AS event_type,
       coalesce(CASE WHEN event_id % 7 <> 0 THEN user_id END, 1) AS user_id,
       CASE WHEN event_id % 7 <> 0 THEN value END AS value,
       CASE WHEN event_id % 7 <> 0 THEN event_type ELSE '' END AS labels
FROM events
"""
)
def fill_null_defaults(spark: SparkSession, directory: str) -> DataFrame:
    """Defaults for a text, a number and a list; a field without one stays NULL."""
    held = F.col("event_id") % 7 != 0
    gaps = _events(spark, directory).select(
        "event_id",
        F.when(held, F.col("event_type")).alias("event_type"),
        F.when(held, F.col("user_id")).alias("user_id"),
        F.when(held, F.col("value")).alias("value"),
        F.when(held, F.array("event_type")).alias("labels"),
    )
    filled = decode.fill_defaults(gaps, {"event_type": "", "user_id": 1, "labels": ""})
    return filled.withColumn("labels", F.array_join("labels", ","))


@query(
    """
SELECT event_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS days,
       epoch_us(ts) // 1000 AS millis, CAST(CAST(ts AS DATE) AS VARCHAR) AS day_again,
       CAST(CAST(ts AS DATE) AS VARCHAR) AS day_of_millis, date_trunc('milliseconds', ts) AS ts_again
FROM events
"""
)
def epoch_time_columns(spark: SparkSession, directory: str) -> DataFrame:
    """Both forms of a time column, and the way back from each."""
    coded = _events(spark, directory).select(
        "event_id", clock.epoch_days("ts").alias("days"), clock.epoch_millis("ts").alias("millis")
    )
    return coded.select(
        "event_id",
        "days",
        "millis",
        clock.day_of("days").cast("string").alias("day_again"),
        clock.day_of_millis("millis").cast("string").alias("day_of_millis"),
        clock.from_epoch_millis("millis").alias("ts_again"),
    )


@query(
    """
SELECT member, count(*) AS n_users, CAST(sum(CASE WHEN has_error THEN 1 ELSE 0 END) AS BIGINT) AS n_with_error
FROM (SELECT unnest(types) AS member, list_contains(types, 'error') AS has_error
      FROM (SELECT user_id, list_distinct(list(event_type)) AS types FROM events GROUP BY user_id))
GROUP BY member
"""
)
def multi_value_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Users per value of a multi-valued column, and how many of them also have 'error'."""
    users = _events(spark, directory).groupBy("user_id").agg(entities.value_set("event_type").alias("types"))
    return entities.count_members(
        users, "types", n_users=F.count("*"), n_with_error=F.count_if(F.array_contains("types", "error"))
    )


@query(
    """
SELECT CAST(user_id AS VARCHAR) AS "userId", '' AS title, '' AS reviewers,
       array_to_string(list_sort(list_distinct(list(event_type))), ',') AS labels,
       count(*) AS "count", count(DISTINCT event_type) AS "numAuthors",
       epoch_us(min(ts)) // 1000 AS "createdTimeMillis", epoch_us(max(ts)) // 1000 AS "mergedTimeMillis",
       (epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000) AS "elapsedTimeMillis"
FROM events GROUP BY user_id
"""
)
def derived_entity_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """The wide merged-change row of every user; lists are shown as text."""
    wide = entities.merged_changes(_events(spark, directory))
    return wide.select(
        "userId",
        "title",
        F.array_join("reviewers", ",").alias("reviewers"),
        F.array_join("labels", ",").alias("labels"),
        "count",
        "numAuthors",
        "createdTimeMillis",
        "mergedTimeMillis",
        "elapsedTimeMillis",
    )


@query(
    """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS total_event_id,
       count(*) FILTER (WHERE event_id % 4 IN (2, 0) AND CAST(ts AS DATE) < DATE '2024-01-20') AS n_merged
FROM events GROUP BY 1
"""
)
def rt_compacted(spark: SparkSession, directory: str) -> DataFrame:
    """A real-time table whose closed days are merged after three batches, of which the newest
    is left alone, and into which a fourth batch comes late."""
    folder, checkpoint = workspace.fresh_path(spark, "topic"), workspace.fresh_path(spark, "checkpoint")
    table = f"{catalog.create_scratch_database(spark, 'compacted')}.{TOPIC}"
    realtime.create_realtime_table(spark, table, EVENT, segment_rows=50_000, cluster_by=["event_type"])
    day = F.col("ts").cast("date")

    def take(part: int) -> None:
        topics.publish_to_folder(_messages(_events(spark, directory).filter(F.col("event_id") % 4 == part)), folder)
        ingest.run_to_end(realtime.ingest_realtime(_stream(spark, folder), table, EVENT, day, checkpoint))

    for part in (2, 0, 3):
        take(part)
    compaction.compact(spark, table, dt.date(2024, 1, 20), ["event_type"], fewest=1)
    compaction.drop_replaced(spark, table)
    take(1)
    spark.catalog.refreshTable(table)
    kept = compaction.visible(spark, table).groupBy("day").agg(
        F.count("*").alias("n_rows"),
        F.sum("event_id").alias("total_event_id"),
        F.count_if(F.col(compaction.BATCH).startswith(compaction.MERGED)).alias("n_merged"),
    )
    return kept.withColumn("day", F.col("day").cast("string"))


@query(
    """
SELECT event_id % 11 = 0 AS quarantined, count(*) AS n_messages,
       CAST(sum(CASE WHEN event_id % 11 <> 0 THEN event_id END) AS BIGINT) AS total_event_id,
       CAST(sum(CASE WHEN event_id % 11 = 0 THEN length('broken ' || event_id) END) AS BIGINT) AS raw_length
FROM events GROUP BY 1
"""
)
def decode_quarantine(spark: SparkSession, directory: str) -> DataFrame:
    """Every eleventh message is broken: good rows land, broken values are set aside."""
    broken = F.concat(F.lit("broken "), F.col("event_id").cast("string"))
    value = F.when(F.col("event_id") % 11 == 0, broken).otherwise(decode.encode_json("*"))
    folder = _published(spark, _messages(_events(spark, directory), value))
    landed, checkpoint = workspace.fresh_path(spark, "landed"), workspace.fresh_path(spark, "checkpoint")
    ingest.run_to_end(ingest.ingest_with_quarantine(_stream(spark, folder), EVENT, landed, checkpoint))
    good, bad = ingest.read_quarantine(spark, EVENT, landed)
    number = lambda column: column.cast("bigint")
    return good.agg(
        F.lit(False).alias("quarantined"),
        F.count("*").alias("n_messages"),
        F.sum("event_id").alias("total_event_id"),
        number(F.lit(None)).alias("raw_length"),
    ).unionByName(
        bad.agg(
            F.lit(True).alias("quarantined"),
            F.count("*").alias("n_messages"),
            number(F.lit(None)).alias("total_event_id"),
            F.sum(F.length("raw_value")).alias("raw_length"),
        )
    )


@query(
    """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", segment, count(*) AS n_rows,
       min(ts) AS first_ts, max(ts) AS last_ts
FROM (SELECT ts, CAST(floor((row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1) / 100) AS BIGINT) AS segment
      FROM events)
GROUP BY 1, 2
"""
)
def rt_segments(spark: SparkSession, directory: str) -> DataFrame:
    """Each day's rows in arrival order, a hundred to a segment."""
    rows = _events(spark, directory).select("event_id", "ts", F.col("ts").cast("date").alias("day"))
    assigned = segments.assign_segments(rows, ["day"], "event_id", 100)
    return (
        assigned.groupBy("day", "segment")
        .agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .withColumn("day", F.col("day").cast("string"))
    )


def _realtime_events(spark: SparkSession, directory: str) -> str:
    """A real-time table of all events, filled from a topic."""
    return _realtime_table(spark, _messages(_events(spark, directory)))


def _realtime_table(spark: SparkSession, messages: DataFrame) -> str:
    folder = _published(spark, messages)
    table = f"{catalog.create_scratch_database(spark, 'realtime')}.{TOPIC}"
    realtime.create_realtime_table(spark, table, EVENT, segment_rows=50_000, cluster_by=["event_type"])
    checkpoint = workspace.fresh_path(spark, "checkpoint")
    day = F.col("ts").cast("date")
    ingest.run_to_end(
        realtime.ingest_realtime(_stream(spark, folder), table, EVENT, day, checkpoint, cluster_by=["event_type"])
    )
    return table


@query(
    """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", count(*) AS n_rows
FROM (SELECT CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN TIMESTAMP '9999-12-31 00:00:00' ELSE ts END AS ts
      FROM events)
WHERE CAST(ts AS DATE) > DATE '2024-01-18' - 7 OR ts IS NULL
GROUP BY 1
"""
)
def rt_retention(spark: SparkSession, directory: str) -> DataFrame:
    """A real-time table after retention on 18 January 2024: the last seven days stay, and
    so do events without a time or dated far ahead, of which there are some of each."""
    odd = (
        F.when(F.col("event_id") % 13 == 0, F.lit(None))
        .when(F.col("event_id") % 17 == 0, F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))
        .otherwise(F.col("ts"))
    )
    table = _realtime_table(spark, _messages(_events(spark, directory).withColumn("ts", odd)))
    retention.drop_expired(spark, table, realtime.DAY, 7, dt.date(2024, 1, 18))
    kept = realtime.read_realtime(spark, table).groupBy("day").agg(F.count("*").alias("n_rows"))
    return kept.withColumn("day", F.col("day").cast("string"))


@query(
    """
SELECT CASE WHEN event_id % 11 = 0 THEN 'broken' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS "day", count(*) AS n_rows,
       CAST(sum(event_id) AS BIGINT) AS total_event_id
FROM events GROUP BY 1
"""
)
def rt_quarantine(spark: SparkSession, directory: str) -> DataFrame:
    """Every eleventh message is broken: good ones are in the table, and the others, by
    their place in the topic, in its quarantine."""
    broken = F.concat(F.lit("{broken "), F.col("event_id").cast("string"))
    value = F.when(F.col("event_id") % 11 == 0, broken).otherwise(decode.encode_json("*"))
    table = _realtime_table(spark, _messages(_events(spark, directory), value))
    good = realtime.read_realtime(spark, table).select(F.col("day").cast("string").alias("day"), "event_id")
    told = F.regexp_extract(F.col("raw_value").cast("string"), "([0-9]+)$", 1).cast("bigint")
    bad = realtime.read_quarantined(spark, table).select(F.lit("broken").alias("day"), told.alias("event_id"))
    both = good.unionByName(bad)
    return both.groupBy("day").agg(F.count("*").alias("n_rows"), F.sum("event_id").alias("total_event_id"))


@query(
    """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", event_type, count(*) AS n_rows,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2
"""
)
def rt_filter_group(spark: SparkSession, directory: str) -> DataFrame:
    """A console query on a real-time table: two types by day."""
    rows = realtime.read_realtime(spark, _realtime_events(spark, directory))
    chosen = rows.filter(F.col("event_type").isin("purchase", "signup"))
    return (
        chosen.groupBy("day", "event_type")
        .agg(F.count("*").alias("n_rows"), F.sum(cents("value")).alias("total"))
        .select(F.col("day").cast("string").alias("day"), "event_type", "n_rows", amount("total").alias("total"))
    )


@query("SELECT CAST(0 AS BIGINT) AS only_decoded, CAST(0 AS BIGINT) AS only_typed, count(*) AS n_rows FROM events")
def dual_path_diff(spark: SparkSession, directory: str) -> DataFrame:
    """Rows that differ between the JSON path and the typed path into a table: none."""
    typed = _events(spark, directory).select(*EVENT.names)
    folder = _published(spark, _messages(typed))
    decoded, _ = decode.decode_json(_replay(spark, folder), EVENT)
    left, right = F.col(sets.LEFT), F.col(sets.RIGHT)

    def surplus(more: Column, less: Column) -> Column:
        return F.sum(F.greatest(more - less, F.lit(0)))

    return sets.row_copies(decoded, typed).agg(
        surplus(left, right).alias("only_decoded"), surplus(right, left).alias("only_typed"), F.sum(left).alias("n_rows")
    )


def _flights(spark: SparkSession, directory: str) -> DataFrame:
    """Flight records made from the lines: a flight per line, from its supplier to its
    part, on its shipping day. Fields that a line says nothing about stay out."""
    ship = F.col("l_shipdate")
    tail = F.concat(F.lit("N"), F.col("l_suppkey").cast("string"))
    made = {
        "DaysSinceEpoch": clock.epoch_days("l_shipdate"),
        "Year": F.year(ship),
        "Quarter": F.quarter(ship),
        "Month": F.month(ship),
        "DayofMonth": F.dayofmonth(ship),
        "DayOfWeek": F.dayofweek(ship),
        "FlightDate": ship.cast("date").cast("string"),
        "Carrier": F.col("l_returnflag"),
        "TailNum": F.when(F.col("l_linestatus") == "F", tail),
        "FlightNum": F.col("l_linenumber"),
        "OriginAirportID": F.col("l_suppkey").cast("int"),
        "DestAirportID": F.col("l_partkey").cast("int"),
        "Distance": F.col("l_quantity").cast("int"),
        "DepDelay": F.when(F.col("l_tax") > 0, F.rint(F.col("l_tax") * 100).cast("int")),
        "DivAirportIDs": F.array(F.col("l_suppkey").cast("int"), F.col("l_partkey").cast("int")),
        "DivAirports": F.when(F.col("l_returnflag") == "R", F.array("l_returnflag", "l_linestatus")),
    }
    lines = tables.read(spark, directory, "lineitem")
    return lines.select(*(value.alias(name) for name, value in made.items()))


@query(
    """
SELECT CAST(year(l_shipdate) AS INTEGER) AS "year", count(*) AS n_flights, CAST(0 AS BIGINT) AS n_differing,
       CAST(sum(CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END) AS BIGINT) AS n_without_tail,
       CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS distance,
       CAST(sum(CASE WHEN l_tax > 0 THEN round(l_tax * 100) END) AS BIGINT) AS delay,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END) AS BIGINT) AS n_diversions
FROM lineitem GROUP BY 1
"""
)
def rt_flights_paths(spark: SparkSession, directory: str) -> DataFrame:
    """Flights by year, read from JSON messages by the flights schema. Each message stays
    beside the typed row it was made from, and no field may differ between the two."""
    schema = FLIGHTS.struct()
    made = _flights(spark, directory).withColumn("value", decode.encode_json("*"))
    typed = F.struct(*decode.projected(made, schema))
    both = decode.parse_json(made.select("value", typed.alias("typed")), schema)
    decoded = F.struct(*(F.col(f"row.{n}") for n in schema.names))
    flights = both.select("row.*", (~decoded.eqNullSafe(F.col("typed"))).alias("differs"))
    return flights.groupBy(F.col("Year").alias("year")).agg(
        F.count("*").alias("n_flights"),
        F.count_if("differs").alias("n_differing"),
        F.count_if(F.col("TailNum").isNull()).alias("n_without_tail"),
        F.sum("Distance").alias("distance"),
        F.sum("DepDelay").alias("delay"),
        F.coalesce(F.sum(F.array_size("DivAirports")), F.lit(0)).alias("n_diversions"),
    )


@query(
    """
SELECT CAST(CAST(last_ts AS DATE) AS VARCHAR) AS "day", count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_events,
       CAST(sum(n_types) AS BIGINT) AS n_labels, CAST(sum(millis) AS BIGINT) AS elapsed_millis, '' AS title,
       CAST(0 AS BIGINT) AS n_expired
FROM (SELECT user_id, max(ts) AS last_ts, count(*) AS n, count(DISTINCT event_type) AS n_types,
             (epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000) AS millis
      FROM events GROUP BY user_id)
GROUP BY 1
"""
)
def rt_declared_table(spark: SparkSession, directory: str) -> DataFrame:
    """Merged-change rows published as JSON and kept as their declared real-time table."""
    wide = entities.merged_changes(_events(spark, directory))
    messages = topics.records(
        wide,
        MERGED_CHANGES.name,
        key=F.col("userId"),
        value=decode.encode_json("*"),
        offset=F.col("mergedTimeMillis"),
        timestamp=F.timestamp_millis("mergedTimeMillis"),
    )
    folder = _published(spark, messages)
    table = f"{catalog.create_scratch_database(spark, 'declared')}.{MERGED_CHANGES.name}"
    realtime.create_declared(spark, table, MERGED_CHANGES)
    stream = topics.read_topic(spark, MERGED_CHANGES.name, folder=folder)
    ingest.run_to_end(
        realtime.ingest_declared(stream, table, MERGED_CHANGES, workspace.fresh_path(spark, "checkpoint"))
    )
    # On the day the newest change was merged, so that nothing is old enough to go.
    expired = realtime.expire_declared(spark, table, MERGED_CHANGES, dt.date(2024, 1, 31))
    return (
        realtime.read_realtime(spark, table)
        .groupBy(F.col("day").cast("string").alias("day"))
        .agg(
            F.count("*").alias("n_entities"),
            F.sum("count").alias("n_events"),
            F.sum(F.array_size("labels")).alias("n_labels"),
            F.sum("elapsedTimeMillis").alias("elapsed_millis"),
            F.max("title").alias("title"),
            F.lit(expired).cast("bigint").alias("n_expired"),
        )
    )


@query(
    """
SELECT date_trunc('hour', ts) AS hour_start, event_type, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY 1, 2
"""
)
def stream_hourly_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """Events published to a topic in four parts, none of them in the order of time, and
    hourly metrics kept by a stream that takes a file at a time."""
    folder = workspace.fresh_path(spark, "topic")
    for part in (2, 0, 3, 1):
        topics.publish_to_folder(_messages(_events(spark, directory).filter(F.col("event_id") % 4 == part)), folder)
    stream = topics.read_topic(spark, TOPIC, folder=folder, options={"maxFilesPerTrigger": "1"})
    rows, _ = decode.decode_json(stream, EVENT)
    events = rows.select(clock.instant("ts").alias("at"), "event_type", "value")
    metrics = f"{catalog.create_scratch_database(spark, 'metrics')}.hourly"
    ingest.run_to_end(hourly.keep_hourly_metrics(events, metrics, workspace.fresh_path(spark, "checkpoint")))
    return hourly.presentable(hourly.read_hourly_metrics(spark, metrics))


@query(
    """
SELECT date_trunc('hour', ts) AS hour_start, event_type, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY 1, 2
"""
)
def batch_hourly_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """The same metrics straight from the table."""
    events = _events(spark, directory).select(clock.instant("ts").alias("at"), "event_type", "value")
    return hourly.presentable(hourly.hourly_metrics(events))
