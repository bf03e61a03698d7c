"""Histograms of entries as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loglake.functions.times import bucket_keys, bucket_label

# Bucket lengths of the units a stream can close; a month has no fixed length.
WINDOWS = {"day": "1 day", "hour": "1 hour", "minute": "1 minute"}

_EPOCH = "1970-01-01 00:00:00"


def as_instant(ts: Column) -> Column:
    """A UTC wall-clock time as the instant it names, whatever the session zone; watermarks need instants."""
    since = (ts - F.lit(_EPOCH).cast("timestamp_ntz")).cast("interval second").cast("decimal(24,6)")
    return F.timestamp_micros((since * 1_000_000).cast("bigint"))


def as_wall_clock(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit(_EPOCH).cast("timestamp_ntz"))


def histogram_stream(entries: DataFrame, unit: str = "hour", by: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """The histogram of a stream of entries: (bucket, [by,] count), as ``histogram`` gives for a table.

    Buckets are event-time windows. In append mode a bucket comes out once, when no entry
    of it can come any more: the latest time seen is over its end by ``lateness``. Until
    then the state holds one counter for each open bucket and value of ``by``; entries that
    are later still are left out. In update mode each change comes out.
    """
    if unit not in WINDOWS:
        raise ValueError(f"a stream counts by {', '.join(WINDOWS)}, not by {unit}")
    timed = entries.where(F.col("ts").isNotNull()).select(as_instant(F.col("ts")).alias("instant"), *([by] if by else []))
    group = [by] if by else []
    counted = timed.withWatermark("instant", lateness).groupBy(F.window("instant", WINDOWS[unit]), *group).agg(
        F.count(F.lit(1)).alias("count"))
    bucket = bucket_label(bucket_keys(as_wall_clock(F.col("window.start")), unit), unit)
    return counted.select(bucket.alias("bucket"), *group, "count")
