from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schemas
from millrace.functions import clock, decode

POINT = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.IntegerType()))])

MESSAGES = [
    '{"id": 1, "name": "a", "tags": [1, 2]}',
    '{"id": 2}',
    '{"name": "c", "id": 3, "unknown": true, "tags": null}',
    '{"id": "x", "name": "d"}',
    "not json",
    "",
    None,
    '{"id": 4, "tags": [5]',
    "{}",
]


def test_good_rows_and_bad_values(spark):
    messages = spark.createDataFrame([(m.encode() if m is not None else None,) for m in MESSAGES], "value binary")
    good, bad = decode.decode_json(messages, POINT)
    assert good.schema.names == ["id", "name", "tags"]
    held = {tuple(map(repr, r)) for r in good.collect()}
    assert held == {
        ("1", "'a'", "[1, 2]"),
        ("2", "None", "None"),
        ("3", "'c'", "None"),
        ("None", "None", "None"),  # the empty object: every field is missing
    }
    assert sorted(r.raw_value for r in bad.collect()) == ["", "", "not json", '{"id": "x", "name": "d"}', '{"id": 4, "tags": [5]']
    assert good.count() + bad.count() == len(MESSAGES)


def test_messages_are_parsed_once(spark, capsys):
    messages = spark.createDataFrame([("{}",)], "value string")
    good, _ = decode.decode_json(messages, POINT)
    good.explain()
    assert capsys.readouterr().out.count("from_json") == 1


def test_json_round_trip_keeps_microseconds_and_arrays(spark):
    rows = spark.sql("SELECT 7L AS id, TIMESTAMP_NTZ'2024-03-10 02:30:00.123456' AS ts, array(1, NULL) AS tags, 0.1D AS x")
    messages = rows.select(decode.encode_json("*").alias("value"))
    good, bad = decode.decode_json(messages, rows.schema)
    assert good.collect() == rows.collect()
    assert bad.count() == 0


def test_envelope(spark):
    bodies = [
        '{"records":[{"key":"key1","value":"value1"},{"key":"key2","value":"value2"}]}',
        '{"records":[]}',
        "broken",
        '{"records":[{"value":"only"}]}',
    ]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    held = sorted(map(tuple, decode.explode_envelope(frame).collect()), key=repr)
    assert held == [("key1", "value1"), ("key2", "value2"), (None, "only")]


def test_fill_defaults_and_projection(spark):
    schema = schemas.MERGED_CHANGES.struct()
    rows = spark.createDataFrame([("u", None, 5, "extra")], "userId string, count bigint, numCommits int, other string")
    projected = decode.project(rows, schema)
    assert projected.schema == schema
    row = decode.fill_defaults(projected, schemas.MERGED_CHANGES.defaults()).first()
    assert (row.userId, row["count"], row.numCommits, row.title, row.labels, row.numComments) == ("u", 1, 5, "", [""], None)


def test_flight_schema():
    struct = schemas.FLIGHTS.struct()
    kinds = [f.dataType.simpleString() for f in struct.fields]
    assert len(kinds) == 79
    assert {k: kinds.count(k) for k in set(kinds)} == {"int": 55, "string": 15, "array<int>": 6, "array<string>": 3}
    assert sum(f.nullable and not f.many for f in schemas.FLIGHTS.fields) == 31
    avro = json.loads(schemas.FLIGHTS.avro())
    types = {f["name"]: f["type"] for f in avro["fields"]}
    assert types["DaysSinceEpoch"] == ["int"]
    assert types["DepDelay"] == ["int", "null"]
    assert types["DivAirportIDs"] == {"type": "array", "items": "int"}


def test_merged_schema():
    declared = schemas.MERGED_CHANGES
    assert len(declared.fields) == 29
    assert [sum(f.role == r for f in declared.fields) for r in ("dimension", "metric", "time")] == [15, 13, 1]
    assert sum(f.many for f in declared.fields) == 8
    assert declared.defaults()["count"] == 1


def test_schema_from_declarations():
    declared = json.dumps(
        {
            "schemaName": "t",
            "dimensionFieldSpecs": [
                {"name": "a", "dataType": "STRING", "defaultNullValue": ""},
                {"name": "b", "dataType": "INT", "singleValueField": False},
            ],
            "metricFieldSpecs": [{"name": "m", "dataType": "LONG", "defaultNullValue": 1}],
            "dateTimeFieldSpecs": [{"name": "d", "dataType": "INT", "format": "1:DAYS:EPOCH", "granularity": "1:DAYS"}],
        }
    )
    config = json.dumps(
        {
            "segmentsConfig": {"retentionTimeUnit": "DAYS", "retentionTimeValue": "60"},
            "tableIndexConfig": {
                "invertedIndexColumns": ["a"],
                "streamConfigs": {"realtime.segment.flush.threshold.size": "500"},
            },
        }
    )
    found = schemas.table_schema(declared, config)
    assert found.struct().simpleString() == "struct<a:string,b:array<int>,m:bigint,d:int>"
    assert found.defaults() == {"a": "", "m": 1}
    assert (found.time_column, found.time_unit, found.retention_days, found.segment_rows, found.cluster_by) == (
        "d",
        "DAYS",
        60,
        500,
        ("a",),
    )
    millis = json.dumps(
        {
            "schemaName": "u",
            "timeFieldSpec": {"incomingGranularitySpec": {"name": "at", "dataType": "LONG", "timeType": "MILLISECONDS"}},
        }
    )
    assert schemas.table_schema(millis).time_unit == "MILLISECONDS"
    with pytest.raises(ValueError, match="HOURS"):
        schemas.table_schema(millis, json.dumps({"segmentsConfig": {"retentionTimeUnit": "HOURS", "retentionTimeValue": "1"}}))


def test_stream_configuration():
    def config(**changed):
        stream = {
            "stream.kafka.topic.name": "t",
            "stream.kafka.broker.list": "h:9092",
            "stream.kafka.decoder.class.name": "some.package.KafkaJSONMessageDecoder",
            "realtime.segment.flush.threshold.time": "3600000",
            "stream.kafka.consumer.prop.auto.offset.reset": "smallest",
        }
        return json.dumps({"tableIndexConfig": {"streamConfigs": {**stream, **changed}}})

    assert schemas.stream_config(config()) == schemas.StreamConfig("t", "h:9092", "json", "earliest", 3600.0)
    other = config(
        **{
            "stream.kafka.decoder.class.name": "some.package.SimpleAvroMessageDecoder",
            "realtime.segment.flush.threshold.time": "12h",
            "stream.kafka.consumer.prop.auto.offset.reset": "largest",
        }
    )
    assert schemas.stream_config(other) == schemas.StreamConfig("t", "h:9092", "avro", "latest", 43200.0)
    assert [schemas._seconds(p) for p in ("1500ms", "90s", "5m", "2d")] == [1.5, 90, 300, 172800]


def test_avro_needs_its_package(spark):
    messages = spark.createDataFrame([(b"x",)], "value binary")
    with pytest.raises(AnalysisException, match="(?i)avro"):
        decode.decode_avro(messages, schemas.FLIGHTS.avro(), schemas.FLIGHTS.struct()).collect()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_time_columns_do_not_depend_on_the_zone(spark, conf, zone):
    conf("spark.sql.session.timeZone", zone)
    moments = [
        dt.datetime(1969, 12, 31, 23, 59, 59, 999999),
        dt.datetime(2024, 3, 10, 2, 30, 0, 123456),
        dt.datetime(2024, 11, 3, 1, 30),
    ]
    frame = spark.createDataFrame([(m,) for m in moments], "ts timestamp_ntz")
    row = frame.select(
        "ts",
        clock.epoch_days("ts").alias("days"),
        clock.epoch_micros("ts").alias("micros"),
        clock.epoch_millis("ts").alias("millis"),
        clock.zone_free(clock.instant("ts")).alias("again"),
        clock.day_of_millis(clock.epoch_millis("ts")).alias("day"),
        clock.hour_of("ts").alias("hour"),
    )
    for r in row.collect():
        micros = (r.ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        assert (r.days, r.micros, r.millis) == ((r.ts.date() - dt.date(1970, 1, 1)).days, micros, micros // 1000)
        assert (r.again, r.day, r.hour) == (r.ts, r.ts.date(), r.ts.replace(minute=0, second=0, microsecond=0))


def test_time_filter_reaches_the_scan(spark, capsys):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.filter(clock.in_year("o_orderdate", 1996)).select(F.col("o_custkey")).explain()
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan
