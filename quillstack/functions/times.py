"""Time functions as column expressions. A null gives a null."""

from __future__ import annotations

import time
from datetime import UTC, datetime, tzinfo
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

MIGRATION_FORMAT, DISPLAY_FORMAT = "yyyy_MM_dd_HHmmss", "yyyy-MM-dd HH:mm:ss"


def migration_timestamp(at: Column) -> Column:
    return F.date_format(at, MIGRATION_FORMAT)


def display_timestamp(at: Column) -> Column:
    return F.date_format(at, DISPLAY_FORMAT)


def generated_timestamp() -> Column:
    return migration_timestamp(F.current_timestamp())


def parsed_timestamp(s: Column) -> Column:
    """Null if s isn't a timestamp of a script."""
    return F.try_to_timestamp(s, F.lit(MIGRATION_FORMAT))


def is_port(n: Column) -> Column:
    return n.between(1, 65535)


def whole_milliseconds(seconds: Column) -> Column:
    return F.floor(seconds * 1000).cast("int")


def _decimal(whole: Column, part: Column, digits: int, unit: str) -> Column:
    """whole.part with part in `digits` places, without zeros or a point at its end."""
    text = F.concat(whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), digits, "0"))
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"0+\z", ""), r"\.\z", ""), F.lit(unit))


def _native(ns: Column) -> Column:
    """A duration in nanoseconds, in its largest units."""
    secs = F.floor(ns / 1_000_000_000)
    rest = ns - secs * 1_000_000_000
    minutes, hours = F.floor(secs / 60), F.floor(secs / 3600)
    tail = _decimal(secs % 60, rest, 9, "s")
    return (
        F.when(ns == 0, F.lit("0s"))
        .when(ns < 1000, F.concat(ns.cast("string"), F.lit("ns")))
        .when(ns < 1_000_000, _decimal(F.floor(ns / 1000), ns % 1000, 3, "µs"))
        .when(ns < 1_000_000_000, _decimal(F.floor(ns / 1_000_000), ns % 1_000_000, 6, "ms"))
        .when(secs < 60, tail)
        .when(secs < 3600, F.concat(minutes.cast("string"), F.lit("m"), tail))
        .otherwise(F.concat(hours.cast("string"), F.lit("h"), (minutes % 60).cast("string"), F.lit("m"), tail))
    )


def duration(ns: Column) -> Column:
    """A duration in nanoseconds for people: whole up to a minute in 1 ms, under 10 s in steps of 10 ms, under 60 s in steps of 100 ms."""
    ns = ns.cast("long")
    return (
        F.when((ns >= 1_000_000) & (ns < 2_000_000), F.lit("1ms"))
        .when((ns >= 1_000_000_000) & (ns < 10_000_000_000), _native(ns - ns % 10_000_000))
        .when((ns >= 10_000_000_000) & (ns < 60_000_000_000), _native(ns - ns % 100_000_000))
        .otherwise(_native(ns))
    )


def in_zone(at: Column, zone: str) -> Column:
    """A UTC time in another zone, or unchanged if there is no such zone."""
    return F.from_utc_timestamp(at, zone) if zone_of(zone) is not UTC else at


def zone_of(zone: str) -> tzinfo:
    try:
        return ZoneInfo(zone) if zone and zone != "UTC" else UTC
    except (ZoneInfoNotFoundError, ValueError):
        return UTC


def current_time(zone: str = "UTC") -> datetime:
    return datetime.now(zone_of(zone))


class Timer:
    """Whole milliseconds since it was made."""

    def __init__(self):
        self.began = time.monotonic()

    def milliseconds(self) -> int:
        return int((time.monotonic() - self.began) * 1000)
