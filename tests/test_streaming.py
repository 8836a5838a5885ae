from __future__ import annotations

import dataclasses
import datetime as dt
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import workspace
from millrace.functions import clock, decode
from millrace.operators import catalog, retention
from millrace.plans.realtime import EVENT, TOPIC, TOPIC_PARTITIONS, _messages
from millrace.schemas import FLIGHTS, MERGED_CHANGES
from millrace.sources import topics
from millrace.streaming import hourly, ingest, realtime

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{SMALL}/events.parquet")


@pytest.fixture
def database(spark):
    name = catalog.create_scratch_database(spark, "streaming_test")
    yield name
    catalog.reset_database(spark, name)


@pytest.fixture
def place(spark):
    return lambda purpose: workspace.fresh_path(spark, purpose)


def publish(events, folder, condition="true"):
    topics.publish_to_folder(_messages(events.filter(condition)), folder)


def stream(spark, folder, **options):
    return topics.read_topic(spark, TOPIC, folder=folder, options=options)


def test_topic_records(spark, events, place):
    folder = place("topic")
    publish(events, folder)
    held = topics.read_topic(spark, TOPIC, folder=folder, streaming=False)
    assert held.schema == topics.RECORD
    assert held.count() == events.count()
    assert {r.partition for r in held.select("partition").distinct().collect()} <= set(range(TOPIC_PARTITIONS))
    assert held.groupBy("key").agg(F.count_distinct("partition").alias("n")).filter("n > 1").count() == 0
    assert topics.read_topic(spark, "another", folder=folder, streaming=False).count() == 0


def test_topic_source_is_chosen_explicitly(spark):
    with pytest.raises(ValueError):
        topics.read_topic(spark, "t")
    with pytest.raises(ValueError):
        topics.read_topic(spark, "t", servers="host:9092", folder="/tmp/t")


def test_kafka_needs_its_package(spark, events):
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        topics.read_topic(spark, "t", servers="host:9092", options={"minPartitions": "10"})
    with pytest.raises(Exception, match="(?i)kafka"):
        topics.publish_to_kafka(_messages(events), "host:9092", "t")


def test_restarted_ingestion_appends_only_what_is_new(spark, events, database, place):
    folder, checkpoint, table = place("topic"), place("checkpoint"), f"{database}.{TOPIC}"

    def run():
        ingest.run_to_end(
            ingest.ingest_topic(stream(spark, folder, maxFilesPerTrigger="1"), table, checkpoint, schema=EVENT, name="job")
        )
        return spark.table(table).count()

    publish(events, folder, "event_id < 300")
    assert run() == 300
    assert run() == 300
    publish(events, folder, "event_id BETWEEN 300 AND 499")
    publish(events, folder, "event_id >= 500")
    assert run() == events.count()
    held = spark.table(table)
    assert held.select(*EVENT.names).exceptAll(events).count() == 0
    assert held.select("record.topic").distinct().collect()[0].topic == TOPIC


def test_raw_ingestion_keeps_the_record(spark, events, database, place):
    folder, table = place("topic"), f"{database}.raw"
    publish(events, folder)
    query = ingest.ingest_topic(stream(spark, folder), table, place("checkpoint"), trigger_seconds=20, name="raw")
    assert [q.name for q in spark.streams.active] == ["raw"]
    query.processAllAvailable()
    ingest.stop_named(spark, "raw")
    assert not any(query.name == "raw" for query in spark.streams.active)
    assert spark.table(table).schema == topics.RECORD
    assert spark.table(table).count() == events.count()


def test_printing_brings_few_rows_to_the_driver(spark, events, database, place, capsys, monkeypatch):
    folder, table = place("topic"), f"{database}.printed"
    publish(events, folder, "event_id < 700")
    publish(events, folder, "event_id >= 700")
    query = ingest.ingest_topic(stream(spark, folder, maxFilesPerTrigger="1"), table, place("checkpoint"))
    limits = []
    shown = type(events).limit
    monkeypatch.setattr(type(events), "limit", lambda self, n: limits.append(n) or shown(self, n))
    ingest.print_batches(spark, query, table, 3, every_seconds=0.2)
    out = capsys.readouterr().out
    assert limits and set(limits) == {3}
    assert out.count("|events|") == 3 * len(limits)
    assert len(spark.streams.active) == 0 and spark.table(table).count() == events.count()
    assert sum(p.numInputRows for p in query.recentProgress) == events.count()  # the topic is read once


def test_ingestion_is_taken_back_whole(spark, events, database, place):
    folder, checkpoint, table = place("topic"), place("checkpoint"), f"{database}.taken_back"

    def run():
        ingest.run_to_end(ingest.ingest_topic(stream(spark, folder), table, checkpoint, schema=EVENT))
        spark.catalog.refreshTable(table)
        return spark.table(table).count()

    publish(events, folder, "event_id < 500")
    assert run() == 500
    catalog.reset_ingested(spark, table, checkpoint)
    assert not spark.catalog.tableExists(table)
    assert run() == 500
    publish(events, folder, "event_id >= 500")
    assert run() == events.count()
    catalog.reset_ingested(spark, table, checkpoint)
    catalog.reset_ingested(spark, table, checkpoint)  # nothing there is fine


def test_running_job_of_the_same_name_is_replaced(spark, events, database, place):
    folder, checkpoint, table = place("topic"), place("checkpoint"), f"{database}.named"
    publish(events, folder)
    first = ingest.ingest_topic(stream(spark, folder), table, checkpoint, trigger_seconds=20, name="named")
    first.processAllAvailable()
    second = ingest.ingest_topic(stream(spark, folder), table, checkpoint, name="named")
    ingest.run_to_end(second)
    assert not first.isActive
    assert spark.table(table).count() == events.count()


def test_quarantine(spark, place):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.StringType())])
    values = ['{"id": 1, "at": "x"}', "broken", None, '{"id": "two"}', '{"id": 2}']
    rows = spark.createDataFrame(list(enumerate(values)), "n bigint, v string")
    messages = topics.records(rows, "q", F.col("n"), F.col("v"), F.col("n"), F.timestamp_seconds("n"))
    folder, landed = place("topic"), place("landed")
    topics.publish_to_folder(messages, folder)
    source = topics.read_topic(spark, "q", folder=folder)
    ingest.run_to_end(ingest.ingest_with_quarantine(source, schema, landed, place("checkpoint")))
    good, bad = ingest.read_quarantine(spark, schema, landed)
    assert sorted(map(tuple, good.collect())) == [(1, "x"), (2, None)]
    assert sorted(r.raw_value for r in bad.collect()) == ["", "broken", '{"id": "two"}']


def test_replayed_batch_is_there_once(spark, events, database, place):
    """A batch whose commit was lost runs again on restart: its rows must not double."""
    folder, checkpoint, table = place("topic"), place("checkpoint"), f"{database}.{TOPIC}"
    publish(events, folder)
    realtime.create_realtime_table(spark, table, EVENT)

    def run():
        source = stream(spark, folder, maxFilesPerTrigger="1")
        ingest.run_to_end(realtime.ingest_realtime(source, table, EVENT, F.col("ts").cast("date"), checkpoint))

    publish(events.withColumn("event_id", F.col("event_id") + 100_000), folder)
    run()
    assert realtime.read_realtime(spark, table).count() == 2 * events.count()
    commits = Path(checkpoint, "commits")
    lost = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (f"{lost}", f".{lost}.crc"):
        (commits / name).unlink(missing_ok=True)
    run()
    assert realtime.read_realtime(spark, table).count() == 2 * events.count()
    assert realtime.read_realtime(spark, table).columns == [*EVENT.names, "day"]


def test_new_checkpoint_leaves_old_rows_alone(spark, events, database, place):
    table = f"{database}.{TOPIC}"
    realtime.create_realtime_table(spark, table, EVENT)
    for condition in ("event_id < 400", "event_id >= 400"):
        folder = place("topic")
        publish(events, folder, condition)
        day = F.col("ts").cast("date")
        ingest.run_to_end(realtime.ingest_realtime(stream(spark, folder), table, EVENT, day, place("checkpoint")))
    held = realtime.read_realtime(spark, table).select(*EVENT.names)
    assert held.count() == events.count()
    assert held.exceptAll(events).count() == 0


def test_metrics_of_an_empty_topic(spark, events, database, place):
    folder, metrics = place("topic"), f"{database}.hourly"
    publish(events, folder, "false")
    rows, _ = decode.decode_json(stream(spark, folder), EVENT)
    timed = rows.select(clock.instant("ts").alias("at"), "event_type", "value")
    ingest.run_to_end(hourly.keep_hourly_metrics(timed, metrics, place("checkpoint")))
    assert hourly.presentable(hourly.read_hourly_metrics(spark, metrics)).collect() == []


def test_retention_drops_whole_days(spark, database):
    table = f"{database}.kept"
    schema = T.StructType([T.StructField("id", T.LongType())])
    realtime.create_realtime_table(spark, table, schema)
    rows = spark.range(100).selectExpr("id", "date'2024-01-01' + CAST(id % 10 AS INT) AS day", "CAST(id % 2 AS STRING) AS batch")
    rows.write.insertInto(table, overwrite=True)
    assert spark.table(table).count() == 100
    expected = retention.retain_days(rows, "day", 3, dt.date(2024, 1, 10)).count()
    odd = spark.range(4).selectExpr("id", "CASE WHEN id > 0 THEN date'9999-12-31' END AS day", "'odd' AS batch")
    odd.write.insertInto(table, overwrite=True)
    today = dt.date(2024, 1, 10)
    assert retention.drop_expired(spark, table, "day", 3, today) == 7  # seven days, of one batch each
    assert spark.table(table).filter("batch = 'odd'").count() == 4  # no day, or one to come
    catalog.drop_partitions(spark, table, [{"day": "9999-12-31", "batch": "odd"}])
    spark.table(table).filter("batch <> 'odd'").count()
    held = spark.table(table).filter("batch <> 'odd'")
    assert held.count() == expected == 30
    assert {r.day.day for r in held.select("day").distinct().collect()} == {8, 9, 10}
    assert retention.drop_expired(spark, table, "day", 3, today) == 0
    assert retention.drop_expired(spark, table, "day", 3, dt.date(2030, 1, 1)) == 3
    assert retention.drop_expired(spark, table, "day", 3, dt.date(2030, 1, 1)) == 0
    assert spark.table(table).count() == 1


def test_declared_tables(spark, database, place):
    table = f"{database}.flights"
    rows = spark.createDataFrame(
        [(i, 3650 * (i % 2) + 19000, f"N{i}", [i, i + 1], [None if i % 2 else "AAA"]) for i in range(20)],
        "FlightNum int, DaysSinceEpoch int, TailNum string, DivAirportIDs array<int>, DivAirports array<string>",
    )
    messages = topics.records(
        rows, "flights", F.col("FlightNum"), decode.encode_json("*"), F.col("FlightNum"), F.timestamp_seconds("FlightNum")
    )
    folder = place("topic")
    topics.publish_to_folder(messages, folder)
    realtime.create_declared(spark, table, FLIGHTS)
    source = topics.read_topic(spark, "flights", folder=folder)
    ingest.run_to_end(realtime.ingest_declared(source, table, FLIGHTS, place("checkpoint")))
    held = realtime.read_realtime(spark, table)
    assert held.columns == [*FLIGHTS.struct().names, "day"]
    assert held.select(*rows.columns).exceptAll(rows).count() == 0
    assert held.filter(F.datediff("day", F.lit("1970-01-01")) != F.col("DaysSinceEpoch")).count() == 0
    assert realtime.expire_declared(spark, table, FLIGHTS, dt.date(1970, 1, 1) + dt.timedelta(days=22650)) == 1  # exactly 3650 days old is too old
    assert spark.table(table).count() == 10


def test_declared_table_limits_its_files(spark, database):
    table = f"{database}.segments"
    realtime.create_realtime_table(spark, table, T.StructType([T.StructField("repo", T.StringType())]), 10, ["repo"])
    rows = spark.range(95).selectExpr("CAST(id AS STRING)", "date'2024-01-01' AS day", "'q-0' AS batch").coalesce(1)
    rows.write.insertInto(table, overwrite=True)
    sizes = spark.table(table).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) <= 10 and sum(r["count"] for r in sizes) == 95


def test_merged_changes_need_a_known_time_unit():
    assert "mergedTimeMillis" in str(realtime.day_by(MERGED_CHANGES))
    with pytest.raises(ValueError, match="HOURS"):
        realtime.day_by(dataclasses.replace(MERGED_CHANGES, time_unit="HOURS"))


def test_hourly_metrics_over_many_batches_equal_the_batch_form(spark, events, database, place):
    folder, checkpoint, table = place("topic"), place("checkpoint"), f"{database}.hourly"

    def run():
        rows, _ = decode.decode_json(stream(spark, folder, maxFilesPerTrigger="1"), EVENT)
        timed = rows.select(clock.instant("ts").alias("at"), "event_type", "value")
        ingest.run_to_end(hourly.keep_hourly_metrics(timed, table, checkpoint))

    def check(condition):
        chosen = events.filter(condition).select(clock.instant("ts").alias("at"), "event_type", "value")
        kept, direct = hourly.read_hourly_metrics(spark, table), hourly.hourly_metrics(chosen)
        assert kept.count() == direct.count()
        assert kept.exceptAll(direct).count() == 0

    for part in range(4):
        publish(events, folder, f"event_id % 4 = {part}")
        run()
        check(f"event_id % 4 <= {part}")
        if part == 2:
            parts = spark.table(table).count()
            assert hourly.merge_parts(spark, table) >= 3
            check("event_id % 4 <= 2")
            assert hourly.read_hourly_metrics(spark, table).count() == spark.table(table).count() < parts
            assert hourly.merge_parts(spark, table) == 0
    hourly.merge_parts(spark, table)
    check("true")


def test_a_merge_counts_once_even_while_what_it_replaces_is_there(spark, events, database, place, monkeypatch):
    folder, table = place("topic"), f"{database}.hourly"
    publish(events, folder)
    rows, _ = decode.decode_json(stream(spark, folder), EVENT)
    timed = rows.select(clock.instant("ts").alias("at"), "event_type", "value")
    ingest.run_to_end(hourly.keep_hourly_metrics(timed, table, place("checkpoint")))
    before = sorted(map(tuple, hourly.read_hourly_metrics(spark, table).collect()))
    monkeypatch.setattr(catalog, "drop_partitions", lambda *_: None)  # the merge stops here
    assert hourly.merge_parts(spark, table) == 1
    assert sorted(map(tuple, hourly.read_hourly_metrics(spark, table).collect())) == before


def test_undecodable_messages_are_kept_apart(spark, database, place):
    schema = T.StructType([T.StructField("id", T.LongType())])
    values = ['{"id": 1}', "broken", None, '{"id": "two"}', '{"id": 2}', "{", '{"id": null}']
    rows = spark.createDataFrame(list(enumerate(values)), "n bigint, v string")
    folder, checkpoint, table = place("topic"), place("checkpoint"), f"{database}.mixed"
    topics.publish_to_folder(topics.records(rows, "q", F.col("n"), F.col("v"), F.col("n"), F.timestamp_seconds("n")), folder)
    realtime.create_realtime_table(spark, table, schema)

    def run():
        source = topics.read_topic(spark, "q", folder=folder)
        ingest.run_to_end(realtime.ingest_realtime(source, table, schema, F.lit("2024-01-01").cast("date"), checkpoint))

    def check():
        assert sorted(r.id or 0 for r in realtime.read_realtime(spark, table).collect()) == [0, 1, 2]
        bad = realtime.read_quarantined(spark, table).collect()
        assert sorted((r.offset, r.raw_value and bytes(r.raw_value).decode()) for r in bad) == [
            (1, "broken"), (2, None), (3, '{"id": "two"}'), (5, "{"),
        ]

    run()
    check()
    for commit in Path(checkpoint, "commits").iterdir():  # the batch runs again
        commit.unlink()
    run()
    check()


@pytest.mark.parametrize("rows", [0, 3, 500])
def test_topic_in_a_given_number_of_files(spark, conf, rows):
    conf("spark.sql.files.maxRecordsPerFile", "10")
    number = F.col("id").cast("string")
    messages = topics.records(spark.range(rows), "t", number, number, F.col("id"), F.lit("2024-01-01"))
    folder = workspace.fresh_path(spark, "topic")
    for _ in range(2):
        topics.publish_to_folder(messages, folder, files=6)
    files = spark.read.parquet(folder)
    assert len(files.inputFiles()) == 12
    assert files.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= rows // 6 + 10
    found = topics.read_topic(spark, "t", folder=folder, streaming=False)
    assert sorted(r.offset for r in found.collect()) == sorted([*range(rows), *range(rows)])
