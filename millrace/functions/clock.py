"""Time columns: epoch days, epoch milliseconds, and zone-free timestamps.

The tables hold TIMESTAMP_NTZ. Everything here reads such a value as UTC, whatever
the session's time zone is, so that no value falls into a daylight-saving gap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3_600 * MICROS_PER_SECOND
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _whole(value: Column, unit: int) -> Column:
    """value / unit, rounded down, without leaving whole numbers."""
    return ((value - F.pmod(value, F.lit(unit))) / F.lit(unit)).cast("bigint")


def epoch_days(ts: str | Column) -> Column:
    """Days since 1970-01-01 (int), the form of a days time column."""
    return F.unix_date(_col(ts).cast("date"))


def day_of(days: str | Column) -> Column:
    """The date of an epoch-days column."""
    return F.date_from_unix_date(_col(days))


def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ."""
    ts = _col(ts)
    seconds_of_day = F.hour(ts) * 3600 + F.minute(ts) * 60
    seconds = F.date_part(F.lit("SECOND"), ts)
    return (
        epoch_days(ts).cast("bigint") * F.lit(MICROS_PER_DAY)
        + seconds_of_day.cast("bigint") * F.lit(MICROS_PER_SECOND)
        + (seconds * F.lit(MICROS_PER_SECOND)).cast("bigint")
    )


def from_epoch_micros(micros: str | Column) -> Column:
    """The TIMESTAMP_NTZ of a count of microseconds since 1970-01-01."""
    seconds = (_col(micros).cast("decimal(20,0)") / F.lit(MICROS_PER_SECOND)).cast("decimal(18,6)")
    zero = F.lit(0)
    return midnight("1970-01-01") + F.make_dt_interval(zero, zero, zero, seconds)


def epoch_millis(ts: str | Column) -> Column:
    """Milliseconds since 1970-01-01 (bigint), the form of a milliseconds time column."""
    return _whole(epoch_micros(ts), 1000)


def from_epoch_millis(millis: str | Column) -> Column:
    return from_epoch_micros(_col(millis) * F.lit(1000))


def day_of_millis(millis: str | Column) -> Column:
    """The date of an epoch-milliseconds column."""
    return F.date_from_unix_date(_whole(_col(millis), MICROS_PER_DAY // 1000).cast("int"))


def instant(ts: str | Column) -> Column:
    """A TIMESTAMP, as watermarks need it, for a TIMESTAMP_NTZ read as UTC."""
    return F.timestamp_micros(epoch_micros(ts))


def zone_free(ts: str | Column) -> Column:
    """The TIMESTAMP_NTZ, in UTC, of a TIMESTAMP."""
    return from_epoch_micros(F.unix_micros(_col(ts)))


def hour_of(ts: str | Column) -> Column:
    """A TIMESTAMP_NTZ cut to its hour."""
    ts = _col(ts)
    return ts.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


def midnight(text: str) -> Column:
    """A TIMESTAMP_NTZ literal for a date written YYYY-MM-DD."""
    return F.lit(text).cast("timestamp_ntz")


def between_days(ts: str | Column, first: str, end: str) -> Column:
    """first <= ts < end, in the form that reaches the Parquet scan."""
    ts = _col(ts)
    return (ts >= midnight(first)) & (ts < midnight(end))


def in_year(ts: str | Column, year: int) -> Column:
    return between_days(ts, f"{year}-01-01", f"{year + 1}-01-01")
