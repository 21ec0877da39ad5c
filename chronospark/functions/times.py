"""Instants with nanoseconds, their texts, local times, and the order of the timeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds between 1601 and 1970.
FILETIME_EPOCH = 11_644_473_600
GROUPS = ("utc_instant", "local_time_with_timezone", "local_time_unknown_timezone", "range", "unknown")


def filetime_seconds(ticks: Column) -> Column:
    """Whole seconds since 1970 of a FILETIME of 100 ns ticks; null for 0."""
    return F.when(ticks != 0, F.floor(ticks / F.lit(10_000_000).cast("decimal(20,0)")).cast("long") - FILETIME_EPOCH)


def filetime_nanos(ticks: Column) -> Column:
    return F.when(ticks != 0, F.pmod(ticks, F.lit(10_000_000)) * 100).cast("int")


def fraction(nanos: Column) -> Column:
    """Nothing, or 3, 6 or 9 digits behind a dot, as few as suffice."""
    digits = F.lpad(nanos.cast("string"), 9, "0")
    return F.when(nanos == 0, "").when(nanos % 1_000_000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 3))).when(nanos % 1_000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 6))).otherwise(F.concat(F.lit("."), digits))


def utc_text(seconds: Column, nanos: Column) -> Column:
    """RFC 3339 with Z. The session must run in UTC."""
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), fraction(nanos), F.lit("Z"))


def text_seconds(text: Column) -> Column:
    return F.unix_seconds(F.to_timestamp(F.substring(text, 1, 19), "yyyy-MM-dd'T'HH:mm:ss"))


def text_nanos(text: Column) -> Column:
    return F.rpad(F.regexp_extract(text, r"\.([0-9]{1,9})", 1), 9, "0").cast("int")


def local_to_utc(local: Column, zone: Column) -> tuple[Column, Column]:
    """(outcome, UTC timestamp) of a local timestamp: single, ambiguous or nonexistent; the timestamp only if single.

    A time that does not survive the way to UTC and back lies in a gap; one that a shift by half or one hour of its
    UTC time also maps to lies in an overlap.
    """
    utc = F.to_utc_timestamp(local, zone)
    shifted = [F.from_utc_timestamp(utc + F.expr(f"INTERVAL {m} MINUTES"), zone) == local for m in (-60, -30, 30, 60)]
    overlap = shifted[0] | shifted[1] | shifted[2] | shifted[3]
    outcome = F.when(F.from_utc_timestamp(utc, zone) != local, "nonexistent").when(overlap, "ambiguous").otherwise("single")
    return outcome, F.when(outcome == "single", utc)


def timeline_key(time: Column, outcome: Column, utc: Column) -> list[tuple[str, Column]]:
    """Columns by which events are ordered: group, then seconds and nanoseconds of instants, or the texts of other times.

    ``outcome`` and ``utc`` are those of the local time in its zone.
    """
    kind = time["type"]
    known = (kind == "local_time") & time["timezone"].isNotNull()
    promoted = F.coalesce(known & (outcome == "single"), F.lit(False))
    instant = (kind == "utc_instant") | promoted
    group = F.when(instant, 1).when(known, 2).when(kind == "local_time", 3).when(kind == "range", 4).otherwise(5)
    seconds = F.when(kind == "utc_instant", text_seconds(time["value"])).when(promoted, F.unix_seconds(utc)).when(kind == "range", text_seconds(time["start"]))
    nanos = F.when(instant, text_nanos(time["value"])).when(kind == "range", text_nanos(time["start"]))
    primary = F.when(known & ~promoted, time["timezone"]).when((kind == "local_time") & ~known, time["value"])
    secondary = F.when(known & ~promoted, time["value"]).when(kind == "range", time["end"])
    return [("time_group", group), ("sec", seconds), ("nano", nanos), ("primary_text", primary), ("secondary_text", secondary)]
