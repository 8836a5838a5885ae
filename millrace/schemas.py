"""Declared table schemas: fields with a role, a default, and a time column."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

_SCALARS = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    role: str = "dimension"  # dimension, metric or time
    many: bool = False  # a multi-valued column
    nullable: bool = True
    default: Any = None

    def spark_type(self) -> T.DataType:
        scalar = _SCALARS[self.type]
        return T.ArrayType(scalar) if self.many else scalar


@dataclass(frozen=True)
class TableSchema:
    """What a real-time table declares about its rows.

    ``time_unit`` is DAYS or MILLISECONDS since 1970-01-01.
    """

    name: str
    fields: tuple[Field, ...]
    time_column: str
    time_unit: str
    retention_days: int | None = None
    segment_rows: int | None = None
    cluster_by: tuple[str, ...] = field(default=())

    def struct(self) -> T.StructType:
        """Every column is nullable: a message may leave any field out."""
        return T.StructType([T.StructField(f.name, f.spark_type(), True) for f in self.fields])

    def defaults(self) -> dict[str, Any]:
        return {f.name: f.default for f in self.fields if f.default is not None}

    def avro(self) -> str:
        """The Avro writer schema of the same rows."""

        def avro_type(f: Field) -> Any:
            if f.many:
                return {"type": "array", "items": f.type}
            return [f.type, "null"] if f.nullable else [f.type]

        fields = [{"name": f.name, "type": avro_type(f)} for f in self.fields]
        return json.dumps({"type": "record", "name": self.name, "fields": fields})


def table_schema(declared: str, config: str | None = None) -> TableSchema:
    """A TableSchema from the JSON declarations of a real-time table.

    ``declared`` lists dimension, metric and time fields; ``config`` is the table's
    own file with its retention, segment size and index columns.
    """
    spec = json.loads(declared)
    fields = [_field(f, role) for role in ("dimension", "metric") for f in spec.get(f"{role}FieldSpecs") or ()]
    if "timeFieldSpec" in spec:
        time = spec["timeFieldSpec"]["incomingGranularitySpec"]
        unit = time["timeType"]
    else:
        time = spec["dateTimeFieldSpecs"][0]
        unit = time["format"].split(":")[1]
    fields.append(_field(time, "time"))

    settings = json.loads(config) if config else {}
    segments = settings.get("segmentsConfig", {})
    index = settings.get("tableIndexConfig", {})
    rows = index.get("streamConfigs", {}).get("realtime.segment.flush.threshold.size")
    retention = segments.get("retentionTimeValue")
    if retention and segments["retentionTimeUnit"] != "DAYS":
        raise ValueError(f"retention in {segments['retentionTimeUnit']} is not supported")
    return TableSchema(
        name=spec["schemaName"],
        fields=tuple(fields),
        time_column=time["name"],
        time_unit=unit,
        retention_days=int(retention) if retention else None,
        segment_rows=int(rows) if rows else None,
        cluster_by=tuple(index.get("invertedIndexColumns", ())),
    )


@dataclass(frozen=True)
class StreamConfig:
    """Where a real-time table's messages come from, and when a segment is closed."""

    topic: str
    servers: str
    message_format: str  # json or avro
    starting: str  # earliest or latest
    segment_seconds: float | None


_UNIT_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3_600, "d": 86_400}


def stream_config(config: str) -> StreamConfig:
    """The stream part of a real-time table's JSON configuration."""
    stream = json.loads(config)["tableIndexConfig"]["streamConfigs"]
    decoder = stream["stream.kafka.decoder.class.name"].rsplit(".", 1)[-1]
    reset = stream.get("stream.kafka.consumer.prop.auto.offset.reset", "smallest")
    closed_after = stream.get("realtime.segment.flush.threshold.time")
    return StreamConfig(
        topic=stream["stream.kafka.topic.name"],
        servers=stream["stream.kafka.broker.list"],
        message_format="avro" if "avro" in decoder.lower() else "json",
        starting="earliest" if reset in ("smallest", "earliest") else "latest",
        segment_seconds=_seconds(closed_after) if closed_after else None,
    )


def _seconds(period: str) -> float:
    """Seconds of a period: plain milliseconds, or a number with a unit such as 12h."""
    if period.isdigit():
        return int(period) / 1000
    number = period.rstrip("smhd")
    return float(number) * _UNIT_SECONDS[period[len(number) :]]


def _field(spec: dict[str, Any], role: str) -> Field:
    return Field(
        name=spec["name"],
        type=spec["dataType"].lower(),
        role=role,
        many=not spec.get("singleValueField", True),
        default=spec.get("defaultNullValue"),
    )


# The flights table. One field a line, in the order of its records;
# "?" marks a field that may be missing, "[]" a field with several values.
_FLIGHT_FIELDS = """
DaysSinceEpoch int
Year int
Quarter int
Month int
DayofMonth int
DayOfWeek int
FlightDate string
UniqueCarrier string
AirlineID int
Carrier string
TailNum string?
FlightNum int
OriginAirportID int
OriginAirportSeqID int
OriginCityMarketID int
Origin string
OriginCityName string
OriginState string
OriginStateFips int
OriginStateName string
OriginWac int
DestAirportID int
DestAirportSeqID int
DestCityMarketID int
Dest string
DestCityName string
DestState string
DestStateFips int
DestStateName string
DestWac int
CRSDepTime int
DepTime int?
DepDelay int?
DepDelayMinutes int?
DepDel15 int?
DepartureDelayGroups int?
DepTimeBlk string
TaxiOut int?
WheelsOff int?
WheelsOn int?
TaxiIn int?
CRSArrTime int
ArrTime int?
ArrDelay int?
ArrDelayMinutes int?
ArrDel15 int?
ArrivalDelayGroups int?
ArrTimeBlk string
Cancelled int
CancellationCode string?
Diverted int
CRSElapsedTime int?
ActualElapsedTime int?
AirTime int?
Flights int
Distance int
DistanceGroup int
CarrierDelay int?
WeatherDelay int?
NASDelay int?
SecurityDelay int?
LateAircraftDelay int?
FirstDepTime int?
TotalAddGTime int?
LongestAddGTime int?
DivAirportLandings int
DivReachedDest int?
DivActualElapsedTime int?
DivArrDelay int?
DivDistance int?
DivAirports string[]
DivAirportIDs int[]
DivAirportSeqIDs int[]
DivWheelsOns int[]
DivTotalGTimes int[]
DivLongestGTimes int[]
DivWheelsOffs int[]
DivTailNums string[]
RandomAirports string[]
"""

# The merged-change table. Text fields and lists of text default to "".
_MERGED_DIMENSIONS = """
title labels[] userId userType authorAssociation mergedBy assignees[] authors[] committers[]
requestedReviewers[] requestedTeams[] reviewers[] commenters[] repo organization
"""
_MERGED_METRICS = """
count numComments numReviewComments numCommits numLinesAdded numLinesDeleted numFilesChanged
numAuthors numCommitters numReviewers numCommenters createdTimeMillis elapsedTimeMillis
"""
_MERGED_COUNT_DEFAULT = 1


def _flight_field(line: str) -> Field:
    name, kind = line.split()
    return Field(
        name=name,
        type=kind.rstrip("?[]"),
        role="time" if name == "DaysSinceEpoch" else "dimension",
        many=kind.endswith("[]"),
        nullable=kind.endswith("?"),
    )


# The names under which these two tables are declared.
FLIGHTS = TableSchema(
    name="airlineStats",
    fields=tuple(_flight_field(line) for line in _FLIGHT_FIELDS.split("\n") if line),
    time_column="DaysSinceEpoch",
    time_unit="DAYS",
    retention_days=3650,
    segment_rows=50_000,
)

MERGED_CHANGES = TableSchema(
    name="pullRequestMergedEvents",
    fields=(
        *(Field(n.removesuffix("[]"), "string", many=n.endswith("[]"), default="") for n in _MERGED_DIMENSIONS.split()),
        *(
            Field(n, "long", role="metric", default=_MERGED_COUNT_DEFAULT if n == "count" else None)
            for n in _MERGED_METRICS.split()
        ),
        Field("mergedTimeMillis", "long", role="time"),
    ),
    time_column="mergedTimeMillis",
    time_unit="MILLISECONDS",
    retention_days=60,
    segment_rows=100_000,
    cluster_by=("organization", "repo"),
)
