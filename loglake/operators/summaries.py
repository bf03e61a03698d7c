"""Per-file summaries: level counts, time span, start/stop sessions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loglake.functions.levels import level_or_unknown
from loglake.schema import MARKERS

# Session markers of each format (start texts, stop texts).
SESSION_MARKERS = {
    "oracle": (
        ["Starting ORACLE instance"],
        ["Shutting down instance", "Instance terminated"],
    ),
    "weblogic": (
        ["Server state changed to STARTING", "Server state changed to RUNNING"],
        ["Server state changed to SHUTDOWN", "Server state changed to FAILED"],
    ),
    "wls_stdout": (
        ["Server state changed to STARTING", "Server state changed to RUNNING"],
        ["Server state changed to SHUTDOWN", "Server state changed to FAILED"],
    ),
}

# Records per chunk of a file when sessions are searched: bounds what one task sorts.
SESSION_CHUNK = 1 << 20


def level_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("file_id", level_or_unknown(F.col("level")).alias("level")).agg(
        F.count(F.lit(1)).alias("count")
    )


def duration_sec(start: Column, stop: Column) -> Column:
    """Whole seconds between two times, the rest cut off; no zone's clock change enters it."""
    return (stop - start).cast("interval second").cast("bigint")


def base_summary(entries: DataFrame) -> DataFrame:
    """Totals, time span and level counts of each file, in one pass over the entries."""
    per_level = entries.groupBy("file_id", level_or_unknown(F.col("level")).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    per_file = per_level.groupBy("file_id").agg(
        F.sum("n").alias("total_records"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("level_counts"),
    )
    return per_file.select(
        "file_id", "total_records", "first_ts", "last_ts",
        F.coalesce(duration_sec(F.col("first_ts"), F.col("last_ts")), F.lit(0).cast("bigint")).alias("duration_sec"),
        "level_counts",
    )


def marker_table(spark: SparkSession, markers: DataFrame | dict) -> DataFrame:
    """Session markers as a table (format, kind, text), ``kind`` being start or stop; other rows are refused."""
    if isinstance(markers, dict):
        rows = [(fmt, kind, text) for fmt, pair in markers.items() for kind, texts in zip(("start", "stop"), pair, strict=True) for text in texts]
        return spark.createDataFrame(rows, MARKERS)
    checked = F.when(F.col("kind").isin("start", "stop"), F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("a session marker is start or stop, not "), F.coalesce(F.col("kind"), F.lit("nothing")))))
    return markers.select(F.col("format").cast("string").alias("format"), checked.alias("kind"), F.col("text").cast("string").alias("text"))


def _flagged(entries: DataFrame, markers: DataFrame | dict) -> DataFrame:
    """Entries of formats with markers as (file_id, seq, ts, is_start, is_stop).

    The markers are a rule table, one row for each format once grouped; Catalyst
    broadcasts it as long as it is small.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("message", F.lit("")), F.coalesce("raw_line", F.lit(""))))
    table = marker_table(entries.sparkSession, markers).where("text <> ''")
    words = table.groupBy("format").agg(*[
        F.collect_set(F.when(F.col("kind") == kind, F.lower("text"))).alias(kind) for kind in ("start", "stop")
    ])

    def any_of(kind: str) -> Column:
        return F.exists(kind, lambda word: F.contains(F.col("seen"), word))

    joined = entries.select("file_id", "seq", "ts", "format", text.alias("seen")).join(words, "format")
    return joined.select("file_id", "seq", "ts", any_of("start").alias("is_start"), any_of("stop").alias("is_stop"))


def _has_marker(text: Column, fmt: Column, markers: dict, which: int) -> Column:
    test = F.lit(False)
    for name, pair in markers.items():
        words = [w.lower() for w in pair[which] if w]
        if words:
            any_word = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
            test = F.when(fmt == name, any_word).otherwise(test)
    return test


def marker_rows(entries: DataFrame, markers: DataFrame | dict) -> DataFrame:
    """Rows that can open or close a session, with what they do.

    ``const`` 1 opens (has a start text and a time), 0 closes (has a stop text), NULL
    toggles (has both and a time: opens when outside, closes when inside).
    """
    if isinstance(markers, dict):
        text = F.lower(F.concat_ws(" ", F.coalesce("message", F.lit("")), F.coalesce("raw_line", F.lit(""))))
        flagged = entries.where(F.col("format").isin(list(markers))).select(
            "file_id", "seq", "ts",
            _has_marker(text, F.col("format"), markers, 0).alias("is_start"),
            _has_marker(text, F.col("format"), markers, 1).alias("is_stop"),
        )
    else:
        flagged = _flagged(entries, markers)
    timed_start = F.col("is_start") & F.col("ts").isNotNull()
    kept = flagged.where(timed_start | F.col("is_stop"))
    return kept.select(
        "file_id", "seq", "ts",
        F.when(timed_start & F.col("is_stop"), F.lit(None).cast("int"))
        .when(timed_start, 1)
        .otherwise(0).alias("const"),
    )


def sessions(entries: DataFrame, markers: DataFrame | dict | None = None, chunk: int = SESSION_CHUNK) -> DataFrame:
    """Start/stop sessions of each file in record order.

    Outside a session the first start with a time opens one, inside the first stop
    closes it; a session closed by a record without a time is not reported, nor is one
    left open. Files are cut into chunks of records, so no task holds a whole file:
    each chunk is solved for both states it can begin in, a window over the small chunk
    table finds the real one, and the chunk's rows then pick their answer.
    """
    rows = marker_rows(entries, SESSION_MARKERS if markers is None else markers).withColumn(
        "chunk", F.floor((F.col("seq") - 1) / chunk)
    ).where(F.col("file_id").isNotNull() & F.col("chunk").isNotNull())  # lets both uses below share one shuffle
    in_order = Window.partitionBy("file_id", "chunk").orderBy("seq")
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn(
        "toggles", F.sum(F.when(F.col("const").isNull(), 1).otherwise(0)).over(running)
    ).select(
        "*",
        F.last("const", ignorenulls=True).over(running).alias("last_const"),
        F.coalesce(
            F.last(F.when(F.col("const").isNotNull(), F.col("toggles")), ignorenulls=True).over(running), F.lit(0)
        ).alias("toggles_then"),
    )

    def state(begin: int) -> Column:
        return (F.coalesce("last_const", F.lit(begin)) + F.col("toggles") - F.col("toggles_then")) % 2

    solved = local.select("file_id", "chunk", "seq", "ts", state(0).alias("after0"), state(1).alias("after1"))
    solved = solved.select(
        "*",
        F.lag("after0", 1, 0).over(in_order).alias("before0"),
        F.lag("after1", 1, 1).over(in_order).alias("before1"),
    )
    for begin in ("0", "1"):
        opens = (F.col("before" + begin) == 0) & (F.col("after" + begin) == 1)
        solved = solved.withColumn(
            "open_ts" + begin, F.last(F.when(opens, F.col("ts")), ignorenulls=True).over(
                in_order.rowsBetween(Window.unboundedPreceding, -1)
            )
        ).withColumn("opens" + begin, opens)

    ends = solved.groupBy("file_id", "chunk").agg(
        F.max_by(F.struct("after0", "after1"), "seq").alias("end"),
        F.max_by(F.when(F.col("opens0"), F.col("ts")), F.when(F.col("opens0"), F.col("seq"))).alias("open0"),
        F.max_by(F.when(F.col("opens1"), F.col("ts")), F.when(F.col("opens1"), F.col("seq"))).alias("open1"),
    )
    # a chunk either sets the state (both ends equal), keeps it or flips it
    chunk_order = Window.partitionBy("file_id").orderBy("chunk")
    upto = chunk_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sets = F.col("end.after0") == F.col("end.after1")
    table = ends.select(
        "file_id", "chunk", "open0", "open1",
        F.when(sets, F.col("end.after0")).alias("set_to"),
        F.sum(F.when(~sets, F.col("end.after0")).otherwise(0)).over(upto).alias("flips"),
    )
    table = table.select(
        "*",
        F.last("set_to", ignorenulls=True).over(upto).alias("last_set"),
        F.coalesce(
            F.last(F.when(F.col("set_to").isNotNull(), F.col("flips")), ignorenulls=True).over(upto), F.lit(0)
        ).alias("flips_then"),
    )
    table = table.withColumn("end_state", (F.coalesce("last_set", F.lit(0)) + F.col("flips") - F.col("flips_then")) % 2)
    table = table.withColumn("begin", F.lag("end_state", 1, 0).over(chunk_order))
    table = table.select(
        "file_id", "chunk", "begin",
        F.last(F.when(F.col("begin") == 0, F.col("open0")).otherwise(F.col("open1")), ignorenulls=True)
        .over(chunk_order.rowsBetween(Window.unboundedPreceding, -1)).alias("carried_open"),
    )

    def pick(name: str) -> Column:
        return F.when(F.col("begin") == 0, F.col(name + "0")).otherwise(F.col(name + "1"))

    closed = solved.join(table, ["file_id", "chunk"]).where(
        (pick("before") == 1) & (pick("after") == 0) & F.col("ts").isNotNull()
    )
    spans = closed.select(
        "file_id", F.coalesce(pick("open_ts"), "carried_open").alias("start_ts"), F.col("ts").alias("stop_ts")
    )
    return spans.select(
        "file_id", "start_ts", "stop_ts",
        duration_sec(F.col("start_ts"), F.col("stop_ts")).alias("duration_sec"),
        F.lit("start-stop").alias("note"),
    )


def session_stats(found: DataFrame) -> DataFrame:
    """Number of sessions of each file and their durations."""
    return found.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("session_count"),
        F.sum("duration_sec").alias("total_sec"),
        F.max("duration_sec").alias("longest_sec"),
    )


_SUMMARIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_summarizer(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Add or replace the summariser of a format.

    ``fn`` gets the entries of all files of that format and returns rows
    (file_id, extras map<string,string>) that are joined to the summary.
    """
    _SUMMARIZERS[name] = fn


def unregister_summarizer(name: str) -> None:
    _SUMMARIZERS.pop(name, None)


def summarizer_names() -> list[str]:
    return sorted({"base", "odl", *SESSION_MARKERS, *_SUMMARIZERS})


def _extras(entries: DataFrame) -> DataFrame | None:
    parts = [fn(entries.where(F.col("format") == name)) for name, fn in sorted(_SUMMARIZERS.items())]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def summarize(
    entries: DataFrame,
    files: DataFrame,
    uploads: DataFrame,
    markers: DataFrame | dict | None = None,
    *,
    nest_sessions: bool = False,
    found: DataFrame | None = None,
) -> DataFrame:
    """The full summary of each file as one struct.

    ``files`` gives encoding and, when it has one, the unpacked ``size_bytes``; the
    upload gives the time of upload and the size for a file that was not archived.
    A format with session markers gets its sessions, any other only the base part.
    Sessions are counted and added up here; as rows they come from ``sessions``. With
    ``nest_sessions`` each file's are also put into the struct as one array, which is for
    files whose sessions are known to be few. ``found`` are the sessions if they were
    searched already.
    """
    base = base_summary(entries)
    found = sessions(entries, markers) if found is None else found
    listed = F.array_sort(F.collect_list(F.struct("start_ts", "stop_ts", "duration_sec", "note")))
    spans = found.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("session_count"), F.sum("duration_sec").alias("session_sec"),
        (listed if nest_sessions else F.lit(None)).alias("sessions"),
    )
    own_size = F.col("f.size_bytes") if "size_bytes" in files.columns else F.lit(None).cast("bigint")
    meta = files.alias("f").join(uploads.alias("u"), F.col("f.upload_id") == F.col("u.id"), "left").select(
        F.col("f.id").alias("file_id"),
        F.coalesce(own_size, F.col("u.size_bytes")).alias("file_size"),
        F.col("u.uploaded_at").alias("uploaded_at"),
        F.col("f.encoding").alias("encoding"),
    )
    joined = meta.join(base, "file_id", "left").join(spans, "file_id", "left")
    extras = _extras(entries)
    joined = joined.join(extras, "file_id", "left") if extras is not None else joined.withColumn(
        "extras", F.lit(None).cast("map<string,string>")
    )
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "file_id",
        F.struct(
            F.coalesce("total_records", zero).alias("total_records"),
            "file_size", "uploaded_at", "encoding", "first_ts", "last_ts",
            F.coalesce("duration_sec", zero).alias("duration_sec"),
            F.coalesce("level_counts", F.create_map().cast("map<string,bigint>")).alias("level_counts"),
            F.coalesce("session_count", zero).alias("session_count"),
            F.coalesce("session_sec", zero).alias("session_sec"),
            (F.coalesce(F.col("sessions"), F.array()) if nest_sessions else F.lit(None)).cast(
                "array<struct<start_ts:timestamp_ntz,stop_ts:timestamp_ntz,duration_sec:bigint,note:string>>"
            ).alias("sessions"),
            "extras",
        ).alias("summary"),
    )
