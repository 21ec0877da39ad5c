"""The timeline: order, filter, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions.times import local_to_utc, text_nanos, text_seconds, timeline_key

ORDER = ["time_group", "sec", "nano", "primary_text", "secondary_text", "event_id"]


def with_instants(events: DataFrame, allow_uncertain: bool = False) -> DataFrame:
    """Columns sec and nano: an event's instant, or null. Local times with a zone and ranges count only if allowed."""
    t = F.col("time")
    is_utc, kind = t["type"] == "utc_instant", t["type"]
    sec, nano = F.when(is_utc, text_seconds(t["value"])), F.when(is_utc, text_nanos(t["value"]))
    if allow_uncertain:
        local = F.to_timestamp(F.substring(t["value"], 1, 19), "yyyy-MM-dd'T'HH:mm:ss")
        _, utc = local_to_utc(local, t["timezone"])
        edge = F.coalesce(t["start"], t["end"])
        sec = F.when(is_utc, text_seconds(t["value"])).when(kind == "local_time", F.unix_seconds(utc)).when(kind == "range", text_seconds(edge))
        nano = F.when(sec.isNotNull(), F.when(kind == "range", text_nanos(edge)).otherwise(text_nanos(t["value"])))
    return events.withColumns({"sec": sec, "nano": nano})


def with_key(events: DataFrame) -> DataFrame:
    """Events with the columns of their place in the order."""
    t = F.col("time")
    local = F.to_timestamp(F.substring(t["value"], 1, 19), "yyyy-MM-dd'T'HH:mm:ss")
    # Step by step, so that no conversion is written out more than once in the plan.
    staged = events.withColumn("__local", F.when((t["type"] == "local_time") & t["timezone"].isNotNull(), local))
    outcome, utc = local_to_utc(F.col("__local"), t["timezone"])
    staged = staged.withColumn("__outcome", outcome).withColumn("__utc", utc)
    return staged.withColumns(dict(timeline_key(t, F.col("__outcome"), F.col("__utc")))).drop("__local", "__outcome", "__utc")


def ordered(events: DataFrame) -> DataFrame:
    """All events by group, time and id; missing parts of a key come last."""
    return with_key(events).orderBy("time_group", *[F.asc_nulls_last(c) for c in ORDER[1:-1]], "event_id")


def numbered(events: DataFrame) -> DataFrame:
    """Events with their key and their ``place`` in the order, from 1; no task holds more than its own range of the order."""
    return storage.numbered(with_key(events), ["time_group", *[F.asc_nulls_last(c) for c in ORDER[1:-1]], "event_id"])


def filtered(events: DataFrame, start: str | None = None, end: str | None = None, types: list[str] | None = None, hosts: list[str] | None = None) -> DataFrame:
    """Bounds are inclusive and hold for events with a definite instant; a host list drops events without a host."""
    out = with_key(events)
    moment = F.struct(F.col("sec").alias("s"), F.col("nano").alias("n"))
    for bound, keep in ((start, lambda b: moment >= b), (end, lambda b: moment <= b)):
        if bound is not None:
            b = F.struct(text_seconds(F.lit(bound)).alias("s"), text_nanos(F.lit(bound)).alias("n"))
            out = out.where((F.col("time_group") != 1) | keep(b))
    if types:
        out = out.where(F.col("event_type").isin(*types))
    return out.where(F.col("hostname").isin(*hosts)) if hosts else out


def summary(events: DataFrame) -> DataFrame:
    """(time_group, n) for the groups that occur."""
    return with_key(events).groupBy("time_group").agg(F.count("*").alias("n"))
