"""Timestamp column functions. Inner window keys are never parsed: they may hold seconds above 59."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeframe.schemas import TS_FORMAT


def parse_ts(col: Column) -> Column:
    """A 14-digit number or text to TIMESTAMP; NULL if it is not a valid time."""
    return F.try_to_timestamp(col.cast("string"), F.lit(TS_FORMAT))


def ts_digits(ts: Column) -> Column:
    """The 14-digit rendering of a timestamp."""
    return F.date_format(ts, TS_FORMAT)


def normalize_ts_digits(col: Column) -> Column:
    """Keep the digits of a rendered timestamp."""
    return F.regexp_replace(col.cast("string"), "[^0-9]", "")


def file_stem(file: Column) -> Column:
    return F.split_part(file, F.lit("."), F.lit(1))


def ts_from_filename(file: Column) -> Column:
    """The stem of a file name as a number, 0 if it is not one."""
    return F.coalesce(file_stem(file).try_cast("bigint"), F.lit(0).cast("bigint"))


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def minute_of(ts: Column) -> Column:
    return F.minute(ts)


def weekday_of(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def peak_hour(hour: Column) -> Column:
    """Rush hours, start included and end excluded."""
    # 7..10 and 17..20.
    return ((hour >= 7) & (hour < 10)) | ((hour >= 17) & (hour < 20))
