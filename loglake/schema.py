"""Schemas of the engine's tables.

Timestamps are ``TIMESTAMP_NTZ`` holding UTC wall-clock time: comparing, bucketing
and printing them does not involve the session time zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

TS = T.TimestampNTZType()

ENTRIES = T.StructType([
    T.StructField("upload_id", T.StringType()),
    T.StructField("file_id", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("format", T.StringType()),
    T.StructField("ts", TS),
    T.StructField("ts_raw", T.StringType()),
    T.StructField("tz_offset", T.StringType()),
    T.StructField("tz_inferred", T.BooleanType()),
    T.StructField("level", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("raw_line", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])

ENTRY_COLUMNS = [f.name for f in ENTRIES.fields]

SESSION = T.StructType([
    T.StructField("start_ts", TS),
    T.StructField("stop_ts", TS),
    T.StructField("duration_sec", T.LongType()),
    T.StructField("note", T.StringType()),
])

SESSIONS = T.StructType([T.StructField("file_id", T.StringType()), *SESSION.fields])

MARKERS = T.StructType([
    T.StructField("format", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
])

SUMMARY = T.StructType([
    T.StructField("total_records", T.LongType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("uploaded_at", TS),
    T.StructField("encoding", T.StringType()),
    T.StructField("first_ts", TS),
    T.StructField("last_ts", TS),
    T.StructField("duration_sec", T.LongType()),
    T.StructField("level_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("session_count", T.LongType()),
    T.StructField("session_sec", T.LongType()),
    T.StructField("sessions", T.ArrayType(SESSION)),
    T.StructField("extras", T.MapType(T.StringType(), T.StringType())),
])

UPLOADS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("md5", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("uploaded_at", TS),
    T.StructField("error", T.StringType()),
])

FILES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("upload_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("path_in_archive", T.StringType()),
    T.StructField("md5", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("record_count", T.LongType()),
    T.StructField("parsed_at", TS),
    T.StructField("encoding", T.StringType()),
    T.StructField("first_ts", TS),
    T.StructField("last_ts", TS),
    T.StructField("duration_sec", T.LongType()),
    T.StructField("pp_status", T.StringType()),
    T.StructField("pp_at", TS),
    T.StructField("summary", SUMMARY),
    T.StructField("error", T.StringType()),
])

FILTERS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("upload_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("created_at", TS),
])

HIGHLIGHTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("upload_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("lexeme", T.IntegerType()),
    T.StructField("created_at", TS),
])

PRESETS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("upload_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("snapshot", T.StringType()),
    T.StructField("created_at", TS),
])

ANNOTATIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("upload_id", T.StringType()),
    T.StructField("file_id", T.StringType()),
    T.StructField("entry_id", T.LongType()),
    T.StructField("ts", TS),
    T.StructField("note", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("created_at", TS),
])
