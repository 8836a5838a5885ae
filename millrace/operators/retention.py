"""Retention: a table keeps its last N days, and whole days go."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.catalog import drop_partitions, quoted


def retain_days(rows: DataFrame, day_col: str, days: int, as_of: dt.date) -> DataFrame:
    """The rows of the last ``days`` days up to ``as_of``; prunes day partitions."""
    return rows.filter(F.col(day_col) > F.lit(as_of - dt.timedelta(days=days)))


def drop_expired(spark: SparkSession, table: str, day_col: str, days: int, as_of: dt.date) -> int:
    """Drop the day partitions that ``retain_days`` would leave out, and say how many.

    Only partition names are looked at, never rows, and only those of expired days reach
    the driver. The calendar decides, not the data: rows of days to come stay, and move
    nothing. Rows without a day (their partition has no date as its name) have no age and
    stay too.
    """
    cutoff = as_of - dt.timedelta(days=days)
    listed = spark.sql(f"SHOW PARTITIONS {quoted(table)}")
    day = F.regexp_extract("partition", f"(?:^|/){re.escape(day_col)}=([^/]*)", 1)
    expired = listed.filter(F.try_to_date(day, "yyyy-MM-dd") <= F.lit(cutoff))
    specs = [dict(part.split("=", 1) for part in row.partition.split("/")) for row in expired.toLocalIterator()]
    drop_partitions(spark, table, specs)
    return len(specs)
