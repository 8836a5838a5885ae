"""Spark event logs: JSON lines, one event a line, one log per application.

A log is a single file named after its application, a rolling folder
``eventlog_v2_<application>``, or a partition folder ``app=<application>`` of an
archive. Logs must not be compressed (``spark.eventLog.compress=false``), so that one
long log is split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Only the fields that the summaries use; the rest is never parsed.
EVENT_SCHEMA = """
    `Event` string,
    `App ID` string,
    `App Name` string,
    `Timestamp` bigint,
    `Stage ID` bigint,
    `Stage Attempt ID` bigint,
    `Task End Reason` struct<`Reason`: string>,
    `Task Info` struct<`Task ID`: bigint, `Launch Time`: bigint, `Finish Time`: bigint, `Failed`: boolean, `Killed`: boolean>,
    `Task Metrics` struct<
        `Executor Run Time`: bigint,
        `Memory Bytes Spilled`: bigint,
        `Disk Bytes Spilled`: bigint,
        `Shuffle Read Metrics`: struct<`Remote Bytes Read`: bigint, `Local Bytes Read`: bigint>,
        `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint>>
"""

_ROLLING_OR_ARCHIVED = r"/(?:eventlog_v2_|app=)([^/]+)/"
_SINGLE_FILE = r"([^/]+?)(?:\.inprogress)?$"


def read_event_log(spark: SparkSession, folder: str) -> DataFrame:
    """The events below a folder, each with the application (``app``) its log belongs to."""
    path = F.col("_metadata.file_path")
    grouped = F.regexp_extract(path, _ROLLING_OR_ARCHIVED, 1)
    single = F.regexp_extract(path, _SINGLE_FILE, 1)
    events = spark.read.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true").json(folder)
    return events.withColumn("app", F.when(grouped != "", grouped).otherwise(single))
