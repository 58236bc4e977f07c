"""Times: readings of numbers and text, zones, weeks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_APPLE = 978_307_200


def from_apple_time(v: Column) -> Column:
    """Seconds, milliseconds or nanoseconds since 2001, told apart by size; zero and null are no time."""
    n = v.cast("double")
    s = F.when(F.abs(n) > 1e14, n / 1e9).when(F.abs(n) > 1e11, n / 1e3).otherwise(n)
    return F.when(n != 0, F.timestamp_millis(((s + _APPLE) * 1000).cast("bigint")))


def from_unix_time(v: Column) -> Column:
    """Seconds, milliseconds or microseconds since 1970, told apart by size."""
    n = v.cast("double")
    s = F.when(F.abs(n) > 1e14, n / 1e6).when(F.abs(n) > 1e11, n / 1e3).otherwise(n)
    return F.when(n != 0, F.timestamp_millis((s * 1000).cast("bigint")))


def loose_date(c: Column) -> Column:
    number = F.when(c.rlike(r"^\d{9,17}(\.\d+)?$"), from_unix_time(F.when(c.rlike(r"^\d{9,17}(\.\d+)?$"), c)))
    return F.coalesce(number, F.try_to_timestamp(F.regexp_replace(F.trim(c), " ", "T")), F.try_to_timestamp(F.trim(c)))


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def zoned_to_utc(local: Column, zone: str) -> Column:
    return F.to_utc_timestamp(local, zone)


def day_bounds(day: Column, zone: str) -> Column:
    start = F.to_utc_timestamp(day.cast("timestamp"), zone)
    return F.struct(start.alias("since"), (start + F.expr("INTERVAL 24 HOURS")).alias("until"))


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def local_hour_minute(ts: Column, zone: str) -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return F.struct(F.hour(local).alias("hour"), F.minute(local).alias("minute"))
