"""Timestamps out of metadata text, as Column expressions in a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats by reader: places, timelines, cross-checks, indicators.
FORMATS = {
    "locator": ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy:MM:dd", "yyyy-MM-dd"),
    "timeline": ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd"),
    "crosscheck": ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd"),
}


def parsed(text: Column, reader: str = "timeline") -> Column:
    """The first format that fits; null if none does. The locator's text ends at a + or a full stop."""
    own = F.trim(text)
    if reader == "locator":
        own = F.trim(F.regexp_extract(own, r"^([^+.]*)", 1))
    return F.coalesce(*[F.try_to_timestamp(own, F.lit(f)) for f in FORMATS[reader]])


def indicated(text: Column) -> Column:
    """ISO 8601 first, then the three common forms."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.trim(text)))
    return F.coalesce(iso, *[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in FORMATS["timeline"][:3]])


def shifted(ts: Column, offset: Column) -> Column:
    """Local time to UTC by an offset like +02:00; as it is without one."""
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    minutes = sign * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int"))
    return F.when(offset.rlike(r"^[+-]\d{2}:\d{2}$"), F.timestamp_micros(F.unix_micros(ts) - minutes.cast("long") * 60_000_000)).otherwise(ts)


def gps_time(date: Column, clock: Column) -> Column:
    """GPSDateStamp with h:m:s."""
    part = lambda k: F.try_element_at(F.split(clock, ":"), F.lit(k)).try_cast("double")
    day = F.to_timestamp(F.to_date(F.try_to_timestamp(F.trim(date), F.lit("yyyy:MM:dd"))))
    seconds = part(1) * 3600 + part(2) * 60 + part(3)
    return F.timestamp_micros(F.unix_micros(day) + (seconds * 1_000_000).cast("long"))


def primary(original: Column, modified: Column, mtime: Column) -> Column:
    """The time that places a record, and where it comes from."""
    source = F.when(original.isNotNull(), "DateTimeOriginal").when(modified.isNotNull(), "ModifyDate").when(mtime.isNotNull(), "FileSystemMtime")
    return F.struct(F.coalesce(original, modified, mtime).alias("ts"), source.alias("source"))


def mtime_before_capture(mtime: Column, capture: Column) -> Column:
    """The file's time lies before the capture, other than by whole quarters of an hour up to a day (a zone's offset)."""
    gap = F.unix_timestamp(capture) - F.unix_timestamp(mtime)
    zoned = (gap < 86_400) & ((gap % 900 < 120) | (gap % 900 > 780))
    return (gap > 0) & ~zoned


def span_text(seconds: Column) -> Column:
    """Seconds, minutes or hours to one place."""
    size = F.abs(seconds)
    return F.when(size < 60, F.format_string("%.1fs", size)).when(size < 3600, F.format_string("%.1fm", size / 60.0)).otherwise(F.format_string("%.1fh", size / 3600.0))
