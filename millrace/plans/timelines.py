"""Events in time: sessions, joins by time, and windows that streams close."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import workspace
from millrace.functions import clock, decode
from millrace.functions.money import amount, cents
from millrace.operators import carry, catalog, intervals, panes, sessions
from millrace.plans.realtime import EVENT, TOPIC, _events, _messages, _published, _stream
from millrace.plans.registry import query
from millrace.sources import tables, topics
from millrace.streaming import ingest, windows

#: A session ends after six hours without an event.
GAP = 6 * 3600
#: How long windows wait for events that come late.
DELAY = 2 * 3600
#: The type of the record that closes what is open: an event long after all others.
CLOSING = "closing"
#: The user of that record. It has one, since Spark leaves out rows without a key before it
#: looks at the time of what it joins.
NOBODY = -1

_SESSIONS_SQL = """
WITH flagged AS (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM flagged)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM numbered GROUP BY user_id, s
"""


def _presented(found: DataFrame) -> DataFrame:
    return found.select("user_id", "session_start", "session_end", "n", amount("cents").alias("total"))


@query(_SESSIONS_SQL)
def user_sessions(spark: SparkSession, directory: str) -> DataFrame:
    """Sessions straight from the table."""
    return _presented(sessions.merged_sessions(_events(spark, directory), ["user_id"], "ts", GAP, {"cents": cents("value")}))


def _in_parts(spark: SparkSession, directory: str, parts: list[str]) -> DataFrame:
    """Events published part by part and then a record that closes all windows; a stream that
    takes a part at a time."""
    events = _events(spark, directory)
    folder = workspace.fresh_path(spark, "topic")
    # A part is a number of files, so that many tasks write it and read it.
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for condition in parts:
        topics.publish_to_folder(_messages(events.filter(condition)), folder, files)
    newest = events.agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id"))
    closing = newest.select(
        (F.col("event_id") + 1).alias("event_id"),
        (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"),
        F.lit(NOBODY).cast("bigint").alias("user_id"),
        F.lit(CLOSING).alias("event_type"),
        F.lit(0.0).alias("value"),
        F.lit(None).cast("string").alias("props"),
    )
    topics.publish_to_folder(_messages(closing).coalesce(1), folder)
    stream = topics.read_topic(spark, TOPIC, folder=folder, options={"maxFilesPerTrigger": str(files)})
    rows, _ = decode.decode_json(stream, EVENT)
    return rows.withColumn("at", clock.instant("ts"))


def _quarter(n: int) -> str:
    """Events of a quarter of the month."""
    days = [0, 8, 16, 24, 400]
    return f"datediff(ts, DATE'2024-01-01') >= {days[n]} AND datediff(ts, DATE'2024-01-01') < {days[n + 1]}"


@query(_SESSIONS_SQL)
def stream_user_sessions(spark: SparkSession, directory: str) -> DataFrame:
    """The same sessions, closed by a stream over four parts of the month."""
    events = _in_parts(spark, directory, [_quarter(n) for n in range(4)])
    table = f"{catalog.create_scratch_database(spark, 'sessions')}.sessions"
    span = f"{GAP} seconds"
    running = windows.keep_windows(
        events,
        F.session_window("at", span),
        F.col("at") + F.make_dt_interval(secs=F.lit(GAP).cast("decimal(18,6)")),
        ["user_id"],
        {"cents": cents("value")},
        DELAY,
        table,
        workspace.fresh_path(spark, "checkpoint"),
    )
    ingest.run_to_end(running)
    closed = windows.read_closed(spark, table).filter(F.col("user_id") != NOBODY)
    zone_free = {c: clock.zone_free(c) for c in ("window_start", "window_end")}
    return _presented(closed.withColumns(zone_free).withColumnsRenamed({"window_start": "session_start", "window_end": "session_end"}))


_LATE_SQL = """
WITH parted AS (SELECT *, CASE event_id % 4 WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS part,
                       date_trunc('hour', ts) AS hour_start FROM events),
seen AS (SELECT part, max(ts) AS newest FROM parted GROUP BY part),
told AS (SELECT p.*, coalesce(p.hour_start + INTERVAL 1 HOUR <= (SELECT max(newest) FROM seen s WHERE s.part < p.part - 1) - INTERVAL 2 HOURS, false) AS late
         FROM parted p)
SELECT hour_start, event_type, count(*) FILTER (NOT late) AS n_on_time, count(*) FILTER (late) AS n_late,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM told GROUP BY 1, 2
"""


@query(_LATE_SQL)
def stream_watermarked_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """Hourly metrics closed by a watermark, and the events that came too late for their hour,
    over four parts that each span the whole month."""
    events = _in_parts(spark, directory, [f"event_id % 4 = {part}" for part in (2, 0, 3, 1)])
    table = f"{catalog.create_scratch_database(spark, 'watermarked')}.hourly"
    running = windows.keep_windows(
        events, F.window("at", "1 hour"), windows.hour_end(), ["event_type"], {"cents": cents("value")}, DELAY, table, workspace.fresh_path(spark, "checkpoint")
    )
    ingest.run_to_end(running)
    closed = windows.read_closed(spark, table).select("window_start", "event_type", F.col("n").alias("n_on_time"), F.lit(0).alias("n_late"), "cents")
    late = windows.read_late(spark, table)
    late = late.select(F.date_trunc("hour", "at").alias("window_start"), "event_type", F.lit(0).alias("n_on_time"), F.lit(1).alias("n_late"), cents("value").alias("cents"))
    both = closed.unionByName(late).filter(F.col("event_type") != CLOSING).groupBy("window_start", "event_type")
    sums = both.agg(F.sum("n_on_time").alias("n_on_time"), F.sum("n_late").alias("n_late"), F.sum("cents").alias("cents"))
    return sums.select(clock.zone_free("window_start").alias("hour_start"), "event_type", "n_on_time", "n_late", amount("cents").alias("total"))


@query(
    """
SELECT e.event_id, e.user_id, e.event_type, p.event_id AS purchase_id, p.value AS purchase_value,
       CAST(floor(epoch_us(e.ts) / 1000000) - floor(epoch_us(p.ts) / 1000000) AS BIGINT) AS seconds_since
FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts
"""
)
def asof_last_purchase(spark: SparkSession, directory: str) -> DataFrame:
    """Each other event with its user's latest purchase until then."""
    events = _events(spark, directory)
    others, purchases = events.filter("event_type <> 'purchase'"), events.filter("event_type = 'purchase'")
    joined = carry.asof_join(others, purchases, ["user_id"], "ts", "ts", "event_id")
    seconds = F.floor(clock.epoch_micros("ts") / 1_000_000) - F.floor(clock.epoch_micros("right.ts") / 1_000_000)
    return joined.select(
        "event_id",
        "user_id",
        "event_type",
        F.col("right.event_id").alias("purchase_id"),
        F.col("right.value").alias("purchase_value"),
        seconds.cast("bigint").alias("seconds_since"),
    )


@query(
    """
WITH spans AS (
    SELECT o_custkey, o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS ordered, min(CAST(l_shipdate AS DATE)) AS shipped_from,
           max(CAST(l_shipdate AS DATE)) + 1 AS shipped_to
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4)
SELECT a.o_orderpriority, count(*) AS n_pairs, CAST(sum(least(a.ordered + 30, b.shipped_to) - greatest(a.ordered, b.shipped_from)) AS BIGINT) AS shared_days
FROM spans a JOIN spans b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey
     AND a.ordered < b.shipped_to AND b.shipped_from < a.ordered + 30
GROUP BY 1
"""
)
def overlapping_orders(spark: SparkSession, directory: str) -> DataFrame:
    """The month after each order against the days on which the customer's other orders shipped."""
    orders, lines = (tables.read(spark, directory, t) for t in ("orders", "lineitem"))
    shipped = lines.groupBy("l_orderkey").agg(
        F.min(clock.epoch_days("l_shipdate")).alias("shipped_from"), (F.max(clock.epoch_days("l_shipdate")) + 1).alias("shipped_to")
    )
    spans = orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("ordered", clock.epoch_days("o_orderdate"))
    # Both sides of the join are made of these, and it reads each of them more than once.
    spans = workspace.written(spans.select("o_custkey", "o_orderkey", "o_orderpriority", "ordered", "shipped_from", "shipped_to"), "order-spans")
    placed = spans.select("o_custkey", "o_orderkey", "o_orderpriority", "ordered", (F.col("ordered") + 30).alias("until"))
    moving = spans.select("o_custkey", "o_orderkey", "shipped_from", "shipped_to")
    pairs = intervals.overlapping(placed, moving, ["o_custkey"], ("ordered", "until"), ("shipped_from", "shipped_to"), 30)
    days = F.least("left.until", "right.shipped_to") - F.greatest("left.ordered", "right.shipped_from")
    others = pairs.filter(F.col("left.o_orderkey") != F.col("right.o_orderkey"))
    return others.groupBy(F.col("left.o_orderpriority").alias("o_orderpriority")).agg(
        F.count("*").alias("n_pairs"), F.sum(days.cast("bigint")).alias("shared_days")
    )


@query(
    """
SELECT c.event_id AS click_id, c.user_id, p.event_id AS purchase_id
FROM (SELECT * FROM events WHERE event_type = 'click') c
LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON p.user_id = c.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 12 HOURS
"""
)
def stream_click_purchases(spark: SparkSession, directory: str) -> DataFrame:
    """Two streams, clicks and purchases, joined by user within twelve hours; clicks without a
    purchase come out once none can follow."""
    events = _in_parts(spark, directory, [_quarter(n) for n in range(4)])
    sides = [events.filter(F.col("event_type").isin(kind, CLOSING)).select("event_id", "user_id", "event_type", "at") for kind in ("click", "purchase")]
    table = f"{catalog.create_scratch_database(spark, 'pairs')}.pairs"
    ingest.run_to_end(windows.keep_pairs(*sides, "user_id", 12 * 3600, DELAY, table, workspace.fresh_path(spark, "checkpoint")))
    spark.catalog.refreshTable(table)
    found = spark.table(table).filter(F.col("left.event_type") != CLOSING)
    return found.select(F.col("left.event_id").alias("click_id"), F.col("left.user_id").alias("user_id"), F.col("right.event_id").alias("purchase_id"))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total_event_id FROM events GROUP BY 1")
def ingest_without_retries(spark: SparkSession, directory: str) -> DataFrame:
    """A topic whose producer sent a third of its records again, some at once and some in the
    next batch, kept once each."""
    messages = _messages(_events(spark, directory))
    again = messages.filter("offset % 3 = 0")
    folder = _published(spark, messages.unionByName(again.filter("offset % 2 = 0")))
    table = f"{catalog.create_scratch_database(spark, 'retries')}.messages"
    checkpoint = workspace.fresh_path(spark, "checkpoint")
    for retried in (again.filter("offset % 2 = 1"), None):
        # The delay spans the topic, so that a record sent again much later is known too.
        ingest.run_to_end(windows.ingest_once(_stream(spark, folder), ["topic", "partition", "offset"], 60 * 86_400, table, checkpoint))
        if retried is not None:
            topics.publish_to_folder(retried, folder)
    spark.catalog.refreshTable(table)
    rows, _ = decode.decode_json(spark.table(table), EVENT)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("total_event_id"))


@query(
    """
WITH spread AS (
    SELECT (epoch_us(ts) // 600000000) * 600 - 600 * i AS window_second, event_type, value FROM events, range(6) AS t(i))
SELECT TIMESTAMP '1970-01-01' + to_seconds(window_second) AS window_start, event_type, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM spread GROUP BY 1, 2
"""
)
def sliding_hourly_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """Metrics of an hour, every ten minutes."""
    second = F.floor(clock.epoch_micros("ts") / 1_000_000)
    found = panes.sliding_sums(_events(spark, directory), second, ["event_type"], 3600, 600, {"cents": cents("value")})
    start = clock.from_epoch_micros(F.col("window_start") * 1_000_000)
    return found.select(start.alias("window_start"), "event_type", "n", amount("cents").alias("total"))
