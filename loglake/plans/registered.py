"""Every operator as a query over the driver's tables, with the SQL it must agree with.

Each query runs over whole tables. A limit is set only where it is the feature: a page
or a top-N report.
"""

from __future__ import annotations

import io
import json
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loglake.functions.levels import level_by_content, level_from_http_status, normalize_level
from loglake.functions.text import SPACE_CODES, attr, contains_like, decode_json, encode_json, json_attr, regexp_match, tokenize
from loglake.functions.times import parse_datetime, time_bucket
from loglake.operators import aggregates, assembly, intake, pages, summaries, views
from loglake.operators.formats import FormatSpec, register_format, unregister_format
from loglake.operators.predicates import entry_filter
from loglake.plans import catalog
from loglake.session import ensure_checkpoint_dir, ship_package
from loglake.sources import tables as T
from loglake.sources.archives import expand_archives
from loglake.sources.encodings import SINGLE_BYTE, decode_text, detect_encoding
from loglake.sources.files import is_zip
from loglake.streaming.ingest import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


# ---- SQL views of the adapters -----------------------------------------------

ENTRIES_SQL = """
entries AS (
  SELECT 'u' || CAST(user_id // 50 AS VARCHAR) AS upload_id,
         'f' || CAST(user_id AS VARCHAR) AS file_id,
         event_id + 1 AS seq, 'text' AS format, ts,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS ts_raw,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning'
              WHEN 'view' THEN NULL ELSE 'info' END AS level,
         event_type AS component,
         event_type || ' value=' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS message,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z ' || event_type || ' user=' || CAST(user_id AS VARCHAR)
           || ' ' || props AS raw_line,
         json_extract_string(props, '$.k') AS k, props, user_id, event_id, event_type, value
  FROM events)"""

FILES_SQL = """
files AS (
  SELECT 'f' || CAST(user_id AS VARCHAR) AS id, 'u' || CAST(user_id // 50 AS VARCHAR) AS upload_id,
         'f' || CAST(user_id AS VARCHAR) || '.log' AS filename,
         count(*) AS record_count, min(ts) AS first_ts, max(ts) AS last_ts
  FROM events GROUP BY user_id)"""

_SPACES = " || ".join(f"chr({code})" for code in SPACE_CODES)
TRIM_SQL = f"trim({{0}}, {_SPACES})"


def trimmed(column: str) -> str:
    return TRIM_SQL.format(column)


DOC_LINES_SQL = f"""
cleaned AS (SELECT doc_id, regexp_replace(text, chr(10) || '$', '') AS text FROM documents),
arrays AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM cleaned WHERE text <> ''),
lines AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM arrays)"""

COLUMNS = ("upload_id", "file_id", "seq", "ts", "level", "component", "message", "raw_line")
_COLS = ", ".join(COLUMNS)


def _hits(**filters) -> Query:
    """All matching entries, no page."""
    def run(spark, folder):
        return T.entries_from_events(spark, folder).where(entry_filter(**filters)).select(*COLUMNS)

    return run


def _hits_sql(where: str) -> str:
    return f"WITH {ENTRIES_SQL} SELECT {_COLS} FROM entries WHERE {where}"


def _any_field(test: str, fields=("ts_raw", "level", "component", "message", "raw_line")) -> str:
    return "(" + " OR ".join("coalesce(" + test.replace("{0}", f) + ", FALSE)" for f in fields) + ")"


# ---- predicates (P) ----------------------------------------------------------

register("search_text_all", _hits_sql(_any_field("{0} ILIKE '%ERR%'")))(_hits(q="ERR"))
register("search_text_raw", _hits_sql("raw_line ILIKE '%USER=1%'"))(_hits(q="USER=1", fields="raw"))
register("search_text_wildcard", _hits_sql(_any_field("{0} ILIKE '%user=1_ %9}%'")))(_hits(q="user=1_ %9}"))
register(
    "search_text_file_fields", _hits_sql(_any_field("{0} ILIKE '%value=1%'", ("message", "raw_line", "component")))
)(_hits(q="value=1", fields="file"))
register("search_regex", _hits_sql(_any_field("regexp_matches({0}, '^(error|sign).*[05]$')")))(
    _hits(q="^(error|sign).*[05]$", mode="regex")
)
register("search_regex_raw", _hits_sql(r"regexp_matches(raw_line, 'user=\d{2} .*k.: 7')"))(
    _hits(q=r"user=\d{2} .*k.: 7", fields="raw", mode="regex")
)
register("attrs_contains", _hits_sql("k LIKE '%1%'"))(_hits(attrs="k:1"))
register("attrs_and", _hits_sql("k LIKE '%1%' AND k LIKE '%2%'"))(_hits(attrs="k:1,k:2"))
register("attrs_exists", _hits_sql("k IS NOT NULL"))(_hits(attrs="k"))
register("attrs_missing", _hits_sql("json_extract_string(props, '$.nothing') LIKE '%1%'"))(_hits(attrs="nothing:1"))
register("level_equals", _hits_sql("level = 'warning'"))(_hits(level="warning"))
register(
    "time_window", _hits_sql("ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts <= TIMESTAMP '2024-01-20 18:30:00'")
)(_hits(ts_from="2024-01-10T06:00:00Z", ts_to="2024-01-20T18:30:00Z"))
register(
    "files_and_window",
    _hits_sql("file_id IN ('f1', 'f3', 'f5') AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND level = 'info'"),
)(_hits(files="f1, f3,f5", ts_from="2024-01-05T00:00:00Z", level="info"))


@register("filename_filter", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%E%'")
def filename_filter(spark, folder):
    return T.table(spark, folder, "part").where(contains_like(F.col("p_name"), "A%E")).select("p_partkey", "p_name")


@register("json_attr", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_attr_query(spark, folder):
    return T.table(spark, folder, "events").select("event_id", json_attr(F.col("props"), "k").alias("k"))


@register("attrs_json", f"WITH {ENTRIES_SQL} SELECT event_id + 1 AS seq, '{{\"k\":\"' || k || '\"}}' AS attrs FROM entries")
def attrs_json(spark, folder):
    return T.entries_from_events(spark, folder).select("seq", encode_json(F.col("attrs")).alias("attrs"))


# ---- pages (L, J1, J2, G10) --------------------------------------------------


@register(
    "search_page",
    f"WITH {ENTRIES_SQL} SELECT {_COLS} FROM entries WHERE upload_id = 'u1' AND "
    + _any_field("{0} ILIKE '%click%'") + " ORDER BY file_id, seq LIMIT 100 OFFSET 50",
)
def search_page(spark, folder):
    hits = pages.search(
        T.entries_from_events(spark, folder), T.files_from_events(spark, folder), "u1", q="click", offset=50
    )
    return hits.select(*COLUMNS)


@register(
    "entries_page",
    f"WITH {ENTRIES_SQL} SELECT {_COLS} FROM entries WHERE file_id = 'f3' AND "
    + _any_field("{0} ILIKE '%value=%'", ("message", "raw_line", "component")) + " ORDER BY seq LIMIT 25 OFFSET 5",
)
def entries_page(spark, folder):
    page = pages.file_entries(T.entries_from_events(spark, folder), "f3", q="value=", limit=25, offset=5)
    return page.items.select(*COLUMNS)


_CORRELATE_SQL = f"WITH {ENTRIES_SQL}, {FILES_SQL}, joined AS (SELECT e.*, f.filename FROM entries e JOIN files f ON f.id = e.file_id)"


@register(
    "correlate_all",
    _CORRELATE_SQL + f" SELECT {_COLS}, filename FROM joined WHERE " + _any_field("{0} ILIKE '%purchase%'"),
)
def correlate_all(spark, folder):
    rows = pages.correlate_rows(
        T.entries_from_events(spark, folder), T.files_from_events(spark, folder), q="purchase"
    )
    return rows.select(*COLUMNS, "filename")


@register(
    "correlate_page",
    _CORRELATE_SQL + f" SELECT {_COLS}, filename FROM joined ORDER BY ts NULLS LAST, seq, file_id LIMIT 100 OFFSET 200",
)
def correlate_page(spark, folder):
    page = pages.correlate(T.entries_from_events(spark, folder), T.files_from_events(spark, folder), offset=200)
    return page.items.select(*COLUMNS, "filename")


@register(
    "correlate_total", _CORRELATE_SQL + " SELECT count(*) AS total FROM joined WHERE upload_id = 'u0' AND level = 'error'"
)
def correlate_total(spark, folder):
    return pages.correlate(
        T.entries_from_events(spark, folder), T.files_from_events(spark, folder), "u0", level="error"
    ).total


@register(
    "correlate_window",
    _CORRELATE_SQL + f" SELECT {_COLS}, filename FROM joined WHERE ts >= TIMESTAMP '2024-01-07 00:00:00' AND "
    "ts <= TIMESTAMP '2024-01-08 00:00:00' ORDER BY ts NULLS LAST, seq, file_id LIMIT 1000",
)
def correlate_window(spark, folder):
    page = pages.correlate(
        T.entries_from_events(spark, folder), T.files_from_events(spark, folder), limit=5000,
        ts_from="2024-01-07T00:00:00Z", ts_to="2024-01-08T00:00:00Z",
    )
    return page.items.select(*COLUMNS, "filename")


@register(
    "correlate_after",
    _CORRELATE_SQL + f" SELECT {_COLS}, filename FROM joined WHERE ts > TIMESTAMP '2024-01-15 12:00:00' "
    "ORDER BY ts NULLS LAST, seq, file_id LIMIT 100",
)
def correlate_after(spark, folder):
    page = pages.correlate(
        T.entries_from_events(spark, folder), T.files_from_events(spark, folder), after=("2024-01-15T12:00:00Z", 1 << 62, "")
    )
    return page.items.select(*COLUMNS, "filename")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of a short list with their place in the order they come out, for SQL to see the order."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


@register(
    "uploads_sorted",
    "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS filename, p_size AS size_bytes, "
    "row_number() OVER (ORDER BY p_size DESC, CAST(p_partkey AS VARCHAR))::INTEGER AS place FROM part WHERE p_name ILIKE '%an%'",
)
def uploads_sorted(spark, folder):
    uploads = T.table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("filename"), F.col("p_size").alias("size_bytes")
    )
    return _placed(pages.uploads_list(uploads, "size_bytes", "desc", filter_text="an"))


@register(
    "files_sorted",
    "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS filename, CAST(s_nationkey AS VARCHAR) AS upload_id, "
    "row_number() OVER (ORDER BY s_name, CAST(s_suppkey AS VARCHAR))::INTEGER AS place FROM supplier",
)
def files_sorted(spark, folder):
    files = T.table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("filename"),
        F.col("s_nationkey").cast("string").alias("upload_id"),
    )
    return _placed(pages.files_list(files))


# ---- aggregates (G) ----------------------------------------------------------

_LABELS = {"month": "%Y-%m", "day": "%Y-%m-%d", "hour": "%Y-%m-%dT%H", "minute": "%Y-%m-%dT%H:%M"}


def _histogram(unit: str, by: str | None = None) -> Query:
    return lambda spark, folder: aggregates.histogram(T.entries_from_events(spark, folder), unit, by)


for _unit, _label in _LABELS.items():
    register(
        f"histogram_{_unit}",
        f"SELECT strftime(ts, '{_label}') AS bucket, count(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY 1",
    )(_histogram(_unit))

register(
    "histogram_by_file",
    "SELECT strftime(ts, '%Y-%m-%dT%H') AS bucket, 'f' || CAST(user_id AS VARCHAR) AS file_id, count(*) AS count "
    "FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
)(_histogram("hour", "file_id"))


@register(
    "histogram_pivot",
    f"WITH {ENTRIES_SQL} SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) FILTER (level = 'error') AS error, "
    "count(*) FILTER (level = 'warning') AS warning, count(*) FILTER (level = 'info') AS info FROM entries GROUP BY 1",
)
def histogram_pivot(spark, folder):
    return aggregates.histogram(
        T.entries_from_events(spark, folder), "day", by="level", pivot=["error", "warning", "info"]
    )


@register(
    "histogram_stack_totals",
    "SELECT bucket, CAST(sum(n) AS BIGINT) AS count, count(*) AS segments FROM (SELECT strftime(ts, '%Y-%m-%dT%H') AS bucket, "
    "user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
)
def histogram_stack_totals(spark, folder):
    return aggregates.stack_totals(_histogram("hour", "file_id")(spark, folder))


@register("histogram_total", "SELECT count(ts) AS total FROM events")
def histogram_total(spark, folder):
    return aggregates.histogram_total(_histogram("hour")(spark, folder))


@register("timeline_bounds", "SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM events")
def timeline_bounds(spark, folder):
    return aggregates.timeline(T.entries_from_events(spark, folder))


@register("time_bucket", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') AS minute, strftime(ts, '%Y-%m') AS month, "
          "strftime(ts, '%Y-%m-%d') AS other FROM events")
def time_bucket_query(spark, folder):
    ts = F.col("ts").cast("timestamp_ntz")
    return T.table(spark, folder, "events").select(
        "event_id", time_bucket(ts, "minute").alias("minute"), time_bucket(ts, "month").alias("month"),
        time_bucket(ts, "week").alias("other"),
    )


@register(
    "storage_stats",
    "SELECT (SELECT CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)), 0) AS BIGINT) FROM orders) AS storage_size, "
    "(SELECT count(*) FROM orders) AS upload_count, (SELECT count(*) FROM lineitem) AS file_count, "
    "(SELECT count(*) FROM events) AS record_count",
)
def storage_stats(spark, folder):
    uploads = T.table(spark, folder, "orders").select(F.floor("o_totalprice").alias("size_bytes"))
    return aggregates.storage_stats(uploads, T.table(spark, folder, "lineitem"), T.table(spark, folder, "events"))


def _order_uploads(spark, folder):
    return T.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("o"), "o_orderkey").alias("filename"), F.lit("zip").alias("kind")
    )


def _line_files(spark, folder):
    shipped = F.col("l_shipdate").cast("timestamp_ntz")
    return T.table(spark, folder, "lineitem").select(
        F.col("l_linenumber").cast("string").alias("id"), F.col("l_orderkey").alias("upload_id"),
        F.concat(F.lit("p"), "l_partkey").alias("filename"), F.lit(None).cast("string").alias("path_in_archive"),
        shipped.alias("first_ts"), (shipped + F.make_dt_interval(days="l_linenumber")).alias("last_ts"),
    )


@register(
    "upload_detail",
    "SELECT o_orderkey AS id, 'o' || CAST(o_orderkey AS VARCHAR) AS filename, 'zip' AS kind, coalesce(n, 0) AS file_count, "
    "first_ts, last_ts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_shipdate) AS first_ts, "
    "max(l_shipdate + to_days(l_linenumber)) AS last_ts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)
def upload_detail(spark, folder):
    return aggregates.upload_detail(_order_uploads(spark, folder), _line_files(spark, folder))


@register(
    "upload_report",
    "SELECT o_orderkey AS id, names FROM orders LEFT JOIN (SELECT l_orderkey, string_agg('p' || CAST(l_partkey AS VARCHAR), ',' "
    "ORDER BY 'p' || CAST(l_partkey AS VARCHAR)) AS names FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)
def upload_report(spark, folder):
    report = intake.upload_report(
        _order_uploads(spark, folder), _line_files(spark, folder).select("id", "upload_id", "filename", "path_in_archive")
    )
    return report.select("id", F.array_join(F.transform("files", lambda f: f["filename"]), ",").alias("names"))


@register(
    "upload_report_rows",
    "SELECT o_orderkey AS id, 'p' || CAST(l_partkey AS VARCHAR) AS filename FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey",
)
def upload_report_rows(spark, folder):
    files = _line_files(spark, folder).select("id", "upload_id", "filename", "path_in_archive")
    report = intake.upload_report(_order_uploads(spark, folder), files, nest=False)
    return report.select("id", F.col("file.filename").alias("filename"))


@register(
    "search_regex_fold", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)ÉLEMENT|ÜBER|[ÄÖ]CH')",
)
def search_regex_fold(spark, folder):
    return T.table(spark, folder, "documents").where(regexp_match(F.col("text"), "(?i)ÉLEMENT|ÜBER|[ÄÖ]CH")).select("doc_id")


@register(
    "search_regex_class", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[[:digit:]]{3}[[:punct:]]|[[&&]{3}|(?m:^[[:upper:]][^[:space:]]+\\.$)')",
)
def search_regex_class(spark, folder):
    pattern = r"[[:digit:]]{3}[[:punct:]]|[[&&]{3}|(?m:^[[:upper:]][^[:space:]]+\.$)"
    return T.table(spark, folder, "documents").where(regexp_match(F.col("text"), pattern)).select("doc_id")


@register(
    "decode_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS text FROM events WHERE event_id % 2 = 0 "
    "UNION ALL SELECT event_id, NULL, event_type FROM events WHERE event_id % 2 = 1",
)
def decode_json_query(spark, folder):
    mixed = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type"))
    found = T.table(spark, folder, "events").select("event_id", decode_json(mixed, "k bigint").alias("x"))
    return found.select("event_id", F.col("x.value.k").alias("k"), F.col("x.text").alias("text"))


_STOP_SQL = ("term NOT IN ('the','a','an','is','to','in','of','and','or','for','on','at','by','with','this','that','it','be',"
             "'as','from')")


def _terms_sql(source: str, tail: str = "") -> str:
    return (
        f"SELECT term, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(t), '[a-z0-9_-]+')) AS term "
        f"FROM ({source})) WHERE {_STOP_SQL} GROUP BY 1{tail}"
    )


@register("terms_documents", _terms_sql("SELECT text AS t FROM documents"))
def terms_documents(spark, folder):
    return aggregates.term_counts(T.table(spark, folder, "documents"))


@register(
    "lexemes_documents",
    _terms_sql("SELECT text || ' ' || text AS t FROM documents", " ORDER BY count DESC, term LIMIT 200"),
)
def lexemes_documents(spark, folder):
    return aggregates.lexemes(T.entries_from_documents(spark, folder), limit=500)


@register(
    "lexemes_conversations",
    _terms_sql("SELECT role || ' ' || text AS t FROM conversations", " ORDER BY count DESC, term LIMIT 20"),
)
def lexemes_conversations(spark, folder):
    entries = T.table(spark, folder, "conversations").select(F.col("role").alias("message"), F.col("text").alias("raw_line"))
    return aggregates.lexemes(entries)


@register("tokenize", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_-]+')) AS tokens, "
          "array_to_string(regexp_extract_all(lower(text), '[a-z0-9_-]+'), ' ') AS joined FROM documents")
def tokenize_query(spark, folder):
    docs = T.table(spark, folder, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.array_join("t", " ").alias("joined"))


# ---- summaries and sessions (G1-G3, W) ---------------------------------------


@register(
    "level_counts",
    f"WITH {ENTRIES_SQL} SELECT file_id, coalesce(level, 'unknown') AS level, count(*) AS count FROM entries GROUP BY 1, 2",
)
def level_counts(spark, folder):
    return summaries.level_counts(T.entries_from_events(spark, folder))


_BASE_SQL = """base AS (
  SELECT file_id, count(*) AS total_records, min(ts) AS first_ts, max(ts) AS last_ts,
         CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS duration_sec,
         count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings,
         count(*) FILTER (level = 'info') AS infos, count(*) FILTER (level IS NULL) AS unknowns
  FROM entries GROUP BY 1)"""


def _flat_counts(counts):
    def one(level):
        return F.coalesce(F.try_element_at(counts, F.lit(level)), F.lit(0)).cast("bigint")

    return [one("error").alias("errors"), one("warning").alias("warnings"), one("info").alias("infos"),
            one("unknown").alias("unknowns")]


@register("base_summary", f"WITH {ENTRIES_SQL}, {_BASE_SQL} SELECT * FROM base")
def base_summary(spark, folder):
    base = summaries.base_summary(T.entries_from_events(spark, folder))
    return base.select("file_id", "total_records", "first_ts", "last_ts", "duration_sec", *_flat_counts(F.col("level_counts")))


EVENT_MARKERS = {"text": (["signup"], ["error"])}

_SESSIONS_SQL = """
marks AS (SELECT file_id, seq, ts, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS k
          FROM entries WHERE event_type IN ('signup', 'error')),
steps AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY file_id ORDER BY seq), 0) AS before FROM marks),
turns AS (SELECT *, lag(ts) OVER (PARTITION BY file_id ORDER BY seq) AS start_ts FROM steps WHERE k <> before),
spans AS (SELECT file_id, start_ts, ts AS stop_ts,
                 CAST(floor((epoch_us(ts) - epoch_us(start_ts)) / 1000000) AS BIGINT) AS duration_sec
          FROM turns WHERE k = 0)"""


@register("sessions_events", f"WITH {ENTRIES_SQL}, {_SESSIONS_SQL} SELECT *, 'start-stop' AS note FROM spans")
def sessions_events(spark, folder):
    return summaries.sessions(T.entries_from_events(spark, folder), EVENT_MARKERS)


@register("sessions_marker_table", f"WITH {ENTRIES_SQL}, {_SESSIONS_SQL} SELECT *, 'start-stop' AS note FROM spans")
def sessions_marker_table(spark, folder):
    """The same markers as a rule table, joined to the entries."""
    return summaries.sessions(T.entries_from_events(spark, folder), summaries.marker_table(spark, EVENT_MARKERS))


@register(
    "session_stats",
    f"WITH {ENTRIES_SQL}, {_SESSIONS_SQL} SELECT file_id, count(*) AS session_count, CAST(sum(duration_sec) AS BIGINT) AS total_sec, "
    "max(duration_sec) AS longest_sec FROM spans GROUP BY 1",
)
def session_stats(spark, folder):
    return summaries.session_stats(sessions_events(spark, folder))


@register(
    "full_summary",
    f"""WITH {ENTRIES_SQL}, {_BASE_SQL}, {_SESSIONS_SQL},
    up AS (SELECT 'u' || CAST(user_id // 50 AS VARCHAR) AS id, min(ts) AS uploaded_at FROM events GROUP BY 1),
    own AS (SELECT DISTINCT file_id, upload_id FROM entries),
    per AS (SELECT file_id, count(*) AS session_count, CAST(sum(duration_sec) AS BIGINT) AS session_sec FROM spans GROUP BY 1)
    SELECT b.*, b.total_records * 100 AS file_size, up.uploaded_at, 'UTF-8' AS encoding,
           coalesce(session_count, 0) AS session_count, coalesce(session_sec, 0) AS session_sec
    FROM base b JOIN own USING (file_id) JOIN up ON up.id = own.upload_id LEFT JOIN per USING (file_id)""",
)
def full_summary(spark, folder):
    full = summaries.summarize(
        T.entries_from_events(spark, folder), T.files_from_events(spark, folder),
        T.uploads_from_events(spark, folder), EVENT_MARKERS,
    )
    s = F.col("summary")
    return full.select(
        "file_id", s["total_records"].alias("total_records"), s["first_ts"].alias("first_ts"), s["last_ts"].alias("last_ts"),
        s["duration_sec"].alias("duration_sec"), *_flat_counts(s["level_counts"]), s["file_size"].alias("file_size"),
        s["uploaded_at"].alias("uploaded_at"), s["encoding"].alias("encoding"),
        s["session_count"].alias("session_count"), s["session_sec"].alias("session_sec"),
    )


@register(
    "summary_extras",
    f"WITH {ENTRIES_SQL} SELECT file_id, count(*) AS total_records, CAST(count(DISTINCT component) AS VARCHAR) AS components "
    "FROM entries GROUP BY 1",
)
def summary_extras(spark, folder):
    """A summariser of one's own adds to the summary."""
    def components(entries):
        kinds = entries.groupBy("file_id", "component").agg(F.count(F.lit(1)).alias("n"))
        counted = kinds.groupBy("file_id").agg(F.count("component").cast("string").alias("c"))
        return counted.select("file_id", F.create_map(F.lit("components"), "c").alias("extras"))

    summaries.register_summarizer("text", components)
    try:
        full = summaries.summarize(
            T.entries_from_events(spark, folder), T.files_from_events(spark, folder),
            T.uploads_from_events(spark, folder), EVENT_MARKERS,
        )
    finally:
        summaries.unregister_summarizer("text")
    return full.select(
        "file_id", F.col("summary.total_records").alias("total_records"), attr(F.col("summary.extras"), "components").alias("components")
    )


# ---- scalar functions (U) ----------------------------------------------------


@register(
    "severity_normalize",
    """SELECT event_id, word, CASE
         WHEN word IN ('ALERT', 'Severe', 'error 7') THEN 'error' WHEN word = 'fatal' THEN 'critical'
         WHEN word IN ('Warn', 'warned') THEN 'warning' WHEN word IN (' Notice ', 'CONFIG') THEN 'info'
         WHEN word = 'FINER' THEN 'debug' WHEN word = 'trace' THEN 'trace' WHEN word = 'ora-1' THEN 'error' END AS level
       FROM (SELECT event_id, [' Notice ', 'ALERT', 'Severe', 'error 7', 'fatal', 'Warn', 'warned', 'CONFIG', 'FINER', 'trace',
             'ora-1', 'other', ''][CAST(event_id % 13 AS INTEGER) + 1] AS word FROM events)""",
)
def severity_normalize(spark, folder):
    words = [" Notice ", "ALERT", "Severe", "error 7", "fatal", "Warn", "warned", "CONFIG", "FINER", "trace", "ora-1", "other", ""]
    word = F.get(F.array(*map(F.lit, words)), F.expr("cast(event_id % 13 as int)"))
    rows = T.table(spark, folder, "events").select("event_id", word.alias("word"))
    return rows.select("event_id", "word", normalize_level(F.col("word")).alias("level"))


@register(
    "http_level",
    "SELECT event_id, CASE WHEN 100 + event_id % 500 >= 500 THEN 'error' WHEN 100 + event_id % 500 >= 400 THEN 'warning' "
    "ELSE 'info' END AS level FROM events",
)
def http_level(spark, folder):
    return T.table(spark, folder, "events").select(
        "event_id", level_from_http_status(100 + F.col("event_id") % 500).alias("level")
    )


_CONTENT_SQL = """CASE WHEN contains(lower({0}), 'critical') OR contains(lower({0}), 'emergency') OR contains(lower({0}), 'fatal')
  THEN 'critical' WHEN contains(lower({0}), 'ora-') OR contains(lower({0}), 'errors') THEN 'error'
  WHEN contains(lower({0}), 'warn') THEN 'warning' END"""


@register("level_by_content", f"SELECT doc_id, {_CONTENT_SQL.format('text')} AS level FROM documents")
def level_by_content_query(spark, folder):
    return T.table(spark, folder, "documents").select("doc_id", level_by_content(F.col("text")).alias("level"))


def _datetime(render, default_tz: str = "UTC") -> Query:
    def run(spark, folder):
        parsed = T.table(spark, folder, "events").select("event_id", parse_datetime(render(), default_tz).alias("d"))
        return parsed.select("event_id", "d.ts", "d.tz_offset", "d.tz_inferred")

    return run


def _datetime_sql(unit: str, offset: str, inferred: bool) -> str:
    return (f"SELECT event_id, date_trunc('{unit}', ts) AS ts, '{offset}' AS tz_offset, {str(inferred).upper()} AS tz_inferred "
            "FROM events")


register("datetime_roundtrip_iso", _datetime_sql("microseconds", "-04:00", False))(
    _datetime(lambda: F.concat(T._at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", -4), F.lit("-04:00"))))
register("datetime_roundtrip_apache", _datetime_sql("second", "+04:00", False))(
    _datetime(lambda: F.concat(T._at("dd/MMM/yyyy:HH:mm:ss", 4), F.lit(" +0400"))))
register("datetime_roundtrip_log4j", _datetime_sql("milliseconds", "", True))(
    _datetime(lambda: T._at("yyyy-MM-dd HH:mm:ss,SSS")))
register("datetime_roundtrip_wls12h", _datetime_sql("second", "", True))(
    _datetime(lambda: F.concat(T._at("MMM d, yyyy h:mm:ss a", 3), F.lit(" MSK")), "Europe/Moscow"))
register("datetime_roundtrip_wls12h_offset", _datetime_sql("second", "+03:00", False))(
    _datetime(lambda: F.concat(T._at("MMM d, yyyy h:mm:ss a", 3), F.lit(" GMT+03:00")), "Europe/Moscow"))
register("datetime_roundtrip_wls24h", _datetime_sql("second", "", True))(
    _datetime(lambda: F.concat(T._at("MMM d, yyyy HH:mm:ss"), F.lit(" MSK"))))
register("datetime_roundtrip_unixdate", _datetime_sql("second", "-04:00", False))(
    _datetime(lambda: F.concat(T._at("EEE MMM d HH:mm:ss", -4), F.lit(" GMT-4 "), T._at("yyyy", -4))))
register("datetime_roundtrip_nodemanager", _datetime_sql("second", "-03:00", False))(
    _datetime(lambda: F.concat(T._at("yyyy-MM-dd", -3), F.lit(" GMT-3 "), T._at("HH:mm:ss", -3))))


# ---- formats, assembly, parsing (D, A, F, I2) --------------------------------

_EXTRA_SQL = "CASE WHEN event_type = 'error' THEN chr(10) || chr(9) || 'at app.Main' ELSE '' END"


def _parsed(fmt: str, *columns: str, attrs: tuple[str, ...] = ()) -> Query:
    def run(spark, folder):
        parsed = assembly.parse_records(T.rendered_records(spark, folder, fmt))
        return parsed.select("event_id", *columns, *[attr(F.col("attrs"), name).alias(name) for name in attrs])

    return run


_LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END"

register(
    "parse_access_roundtrip",
    f"""WITH {ENTRIES_SQL} SELECT event_id, date_trunc('second', ts) AS ts, '+04:00' AS tz_offset, FALSE AS tz_inferred,
    {_LEVEL_SQL} AS level, 'GET /' || event_type || '/' || CAST(event_id AS VARCHAR) AS component,
    'GET /' || event_type || '/' || CAST(event_id AS VARCHAR) || ' HTTP/1.1' AS message, 'h' || CAST(user_id AS VARCHAR) AS host,
    CASE event_type WHEN 'error' THEN '500' WHEN 'purchase' THEN '404' ELSE '200' END AS status,
    CAST(event_id AS VARCHAR) AS size FROM entries""",
)(_parsed("access", "ts", "tz_offset", "tz_inferred", "level", "component", "message", attrs=("host", "status", "size")))
register(
    "parse_java_roundtrip",
    f"""WITH {ENTRIES_SQL} SELECT event_id, date_trunc('milliseconds', ts) AS ts, '' AS tz_offset, TRUE AS tz_inferred,
    {_LEVEL_SQL} AS level, 'app.' || event_type AS component, message || {_EXTRA_SQL} AS message,
    't-' || CAST(user_id AS VARCHAR) AS thread FROM entries""",
)(_parsed("java", "ts", "tz_offset", "tz_inferred", "level", "component", "message", attrs=("thread",)))
register(
    "parse_weblogic_roundtrip",
    f"""WITH {ENTRIES_SQL} SELECT event_id, date_trunc('milliseconds', ts) AS ts, 'Z' AS tz_offset, FALSE AS tz_inferred,
    {_LEVEL_SQL} AS level, event_type AS component, message || {_EXTRA_SQL} AS message,
    'm' || CAST(user_id AS VARCHAR) AS machine, 'BEA-' || CAST(event_id AS VARCHAR) AS code,
    CAST(epoch_us(ts) // 1000 AS VARCHAR) AS millis FROM entries""",
)(_parsed("weblogic", "ts", "tz_offset", "tz_inferred", "level", "component", "message", attrs=("machine", "code", "millis")))
register(
    "parse_wls_roundtrip",
    f"""WITH {ENTRIES_SQL} SELECT event_id, date_trunc('second', ts) AS ts, '+03:00' AS tz_offset, FALSE AS tz_inferred,
    {_LEVEL_SQL} AS level, event_type AS component, message || {_EXTRA_SQL} AS message FROM entries""",
)(_parsed("wls_stdout", "ts", "tz_offset", "tz_inferred", "level", "component", "message"))
register(
    "parse_odl_roundtrip",
    f"""WITH {ENTRIES_SQL} SELECT event_id, date_trunc('milliseconds', ts) AS ts, '+04:00' AS tz_offset, FALSE AS tz_inferred,
    {_LEVEL_SQL} AS level, event_type AS component, message || {_EXTRA_SQL} AS message, 'mod' AS module,
    't' || CAST(user_id AS VARCHAR) AS tid, 'e' || CAST(event_id AS VARCHAR) AS ecid FROM entries""",
)(_parsed("odl", "ts", "tz_offset", "tz_inferred", "level", "component", "message", attrs=("module", "tid", "ecid")))
register(
    "parse_oracle_roundtrip",
    f"""WITH {ENTRIES_SQL} SELECT event_id, ts, '-04:00' AS tz_offset, FALSE AS tz_inferred, CAST(NULL AS VARCHAR) AS level,
    message FROM entries""",
)(_parsed("oracle", "ts", "tz_offset", "tz_inferred", "level", "message"))
register(
    "parse_text_roundtrip",
    f"""WITH {ENTRIES_SQL} SELECT event_id, date_trunc('second', ts) AS ts, '-04:00' AS tz_offset, FALSE AS tz_inferred,
    '##### ' || strftime(ts - INTERVAL 4 HOUR, '%a %b %-d %H:%M:%S GMT-4 %Y') || ' ' || message AS message FROM entries""",
)(_parsed("text", "ts", "tz_offset", "tz_inferred", "message"))

_FORMAT_SQL = "[" + ", ".join(f"'{f}'" for f in T.EVENT_FORMATS) + "][CAST(user_id % 7 AS INTEGER) + 1]"


@register("detect_format", f"SELECT DISTINCT 'f' || CAST(user_id AS VARCHAR) AS file_id, {_FORMAT_SQL} AS format FROM events")
def detect_format(spark, folder):
    return assembly.detect_lines(T.rendered_lines(spark, folder))


@register(
    "parse_mixed_logs",
    f"""WITH {ENTRIES_SQL}, mixed AS (SELECT *, {_FORMAT_SQL} AS fmt FROM entries)
    SELECT file_id, fmt AS format, row_number() OVER (PARTITION BY file_id ORDER BY event_id) AS seq,
      CASE WHEN fmt = 'oracle' THEN ts WHEN fmt IN ('weblogic', 'java', 'odl') THEN date_trunc('milliseconds', ts)
           ELSE date_trunc('second', ts) END AS ts,
      CASE WHEN fmt IN ('oracle', 'text') THEN NULL ELSE {_LEVEL_SQL} END AS level,
      CASE WHEN fmt = 'access' THEN 'GET /' || event_type || '/' || CAST(event_id AS VARCHAR) || ' HTTP/1.1'
           WHEN fmt = 'oracle' THEN message
           WHEN fmt = 'text' THEN '##### ' || strftime(ts - INTERVAL 4 HOUR, '%a %b %-d %H:%M:%S GMT-4 %Y') || ' ' || message
           ELSE message || {_EXTRA_SQL} END AS message
    FROM mixed""",
)
def parse_mixed_logs(spark, folder):
    lines = T.rendered_lines(spark, folder)
    records = assembly.assemble_lines(lines, assembly.detect_lines(lines))
    return assembly.parse_records(records).select("file_id", "format", "seq", "ts", "level", "message")


# Two formats for prose: a record begins at a capital letter; in the second one only
# lines beginning with a small letter go on with it.
PROSE = FormatSpec("prose", head="[A-Z]")
STRICT_PROSE = FormatSpec("strict", head="[A-Z]", continuation="^[a-z]")

_HEAD_TEST = f"regexp_matches({trimmed('line')}, '^[A-Z]')"

_ASSEMBLE_SQL = f"""WITH {DOC_LINES_SQL},
flags AS (SELECT *, {_HEAD_TEST} AS head, {trimmed('line')} = '' AS blank,
          {{cont}} AS cont FROM lines),
marked AS (SELECT *, CASE WHEN head THEN 1 WHEN NOT cont AND NOT blank THEN 0 END AS mark FROM flags),
states AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY n
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS state FROM marked),
starts AS (SELECT *, head OR mark = 0 OR (NOT blank AND state = 0) AS begins FROM states),
numbered AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY n) AS seq
             FROM (SELECT *, coalesce(begins, FALSE) AS b FROM starts) WHERE b OR state = 1)
SELECT file_id, CAST(seq AS BIGINT) AS seq,
       string_agg(CASE WHEN head THEN {trimmed('line')} ELSE line END, chr(10) ORDER BY n) AS raw_line
FROM numbered GROUP BY 1, 2"""


def _assembled_whole(spec: FormatSpec) -> Query:
    def run(spark, folder):
        texts = T.texts_from_documents(spark, folder).withColumn("text", assembly.clean_text(F.col("text")))
        return assembly.split_records(texts.withColumn("format", F.lit(spec.name)), specs=[spec]).select(
            "file_id", "seq", "raw_line")

    return run


def _assembled_lines(spec: FormatSpec) -> Query:
    def run(spark, folder):
        lines = T.document_lines(spark, folder)
        return assembly.assemble_lines(lines, spec.name, specs=[spec]).select("file_id", "seq", "raw_line")

    return run


for _name, _spec, _cont in (
    ("assemble_records", PROSE, "TRUE"),
    ("assemble_java", STRICT_PROSE, "regexp_matches(line, '^[a-z]')"),
):
    register(_name, _ASSEMBLE_SQL.replace("{cont}", _cont))(_assembled_whole(_spec))
    register(_name + "_lines", _ASSEMBLE_SQL.replace("{cont}", _cont))(_assembled_lines(_spec))


@register("line_numbers", f"WITH {DOC_LINES_SQL} SELECT file_id, CAST(n AS BIGINT) AS line_no, line AS value FROM lines")
def line_numbers(spark, folder):
    return assembly.number_lines(T.document_lines(spark, folder)).select(
        "file_id", F.col("line_no").cast("bigint").alias("line_no"), "value")


@register(
    "parse_documents",
    f"""WITH {DOC_LINES_SQL}, kept AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n) AS seq FROM lines
        WHERE {trimmed('line')} <> '')
    SELECT file_id, 'text' AS format, seq, {trimmed('line')} AS message, line AS raw_line,
           {_CONTENT_SQL.format('line')} AS level FROM kept""",
)
def parse_documents(spark, folder):
    texts = T.texts_from_documents(spark, folder).withColumn("text", assembly.clean_text(F.col("text")))
    records = assembly.split_records(assembly.detect_text(texts))
    return assembly.parse_records(records).select("file_id", "format", "seq", "message", "raw_line", "level")


# ---- intake (I) --------------------------------------------------------------


@register(
    "kind_detection",
    "SELECT page_id, CASE WHEN lower(url) LIKE '%.zip' OR left(html, 4) = 'PK' || chr(3) || chr(4) THEN 'zip' ELSE 'file' END AS kind "
    "FROM pages",
)
def kind_detection(spark, folder):
    zipped = is_zip(F.col("url"), F.col("html").cast("binary"))
    return T.table(spark, folder, "pages").select("page_id", F.when(zipped, "zip").otherwise("file").alias("kind"))


@register(
    "content_hash", "SELECT doc_id, md5(text) AS md5, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents"
)
def content_hash(spark, folder):
    return T.table(spark, folder, "documents").select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.octet_length("text").cast("bigint").alias("size_bytes"))


def _batch(spark, folder):
    return T.table(spark, folder, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("filename"),
        F.md5(F.col("text").cast("binary")).alias("md5"), F.octet_length("text").cast("bigint").alias("size_bytes"))


_BATCH_SQL = """batch AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS filename, md5(text) AS md5,
  CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents)"""


@register(
    "dedup_first",
    f"""WITH {_BATCH_SQL} SELECT id, filename FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY filename) AS r FROM batch)
    WHERE r = 1""",
)
def dedup_first(spark, folder):
    none = spark.createDataFrame([], "id string, md5 string")  # nothing was uploaded before
    report = intake.duplicate_report(_batch(spark, folder), none)
    return report.where(F.col("status") == "accepted").select("id", "filename")


@register(
    "dedup_report",
    f"""WITH {_BATCH_SQL}, known AS (SELECT md5(text) AS md5, 'e' || min(CAST(doc_id AS VARCHAR)) AS known_id
      FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1),
    ranked AS (SELECT *, size_bytes > 20000 AS over, first_value(id) OVER (PARTITION BY md5, size_bytes > 20000 ORDER BY filename) AS first_id
      FROM batch)
    SELECT r.id, CASE WHEN over THEN 'failed' WHEN known_id IS NOT NULL OR first_id <> r.id THEN 'duplicate' ELSE 'accepted' END AS status,
      CASE WHEN over THEN NULL WHEN known_id IS NOT NULL THEN known_id WHEN first_id <> r.id THEN first_id END AS existing_upload_id
    FROM ranked r LEFT JOIN known USING (md5)""",
)
def dedup_report(spark, folder):
    good = T.table(spark, folder, "labels").where("quality = 1").select("doc_id")
    known = T.table(spark, folder, "documents").join(good, "doc_id", "left_semi").select(
        F.concat(F.lit("e"), "doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("md5"))
    report = intake.duplicate_report(_batch(spark, folder), known, max_bytes=20000)
    return report.select("id", "status", "existing_upload_id")


@register("decode_latin1", "SELECT doc_id, text FROM documents")
def decode_latin1(spark, folder):
    """Documents written in ISO-8859-1 where they can be, detected and decoded again."""
    docs = T.table(spark, folder, "documents")
    fits = ~F.col("text").rlike(r"[^\x{00}-\x{FF}]")
    stored = docs.select("doc_id", F.when(fits, F.encode(F.when(fits, F.col("text")), "ISO-8859-1")).otherwise(
        F.col("text").cast("binary")).alias("content"))
    named = stored.withColumn("encoding", detect_encoding(F.col("content")))
    return named.select("doc_id", decode_text(F.col("content"), F.col("encoding")).alias("text"))


_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопчрстувшьюя"
_TWO_CASES = (_LATIN + _LATIN.upper(), _CYRILLIC + _CYRILLIC.upper())


@register(
    "decode_cyrillic",
    f"""SELECT doc_id, e.encoding, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN e.encoding ELSE 'UTF-8' END AS detected,
    translate(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '{_TWO_CASES[0]}', '{_TWO_CASES[1]}') AS text
    FROM documents, (VALUES ('Windows-1251'), ('ISO-8859-5')) AS e(encoding)""",
)
def decode_cyrillic(spark, folder):
    """Documents in Cyrillic letters, written in two single-byte encodings, detected and decoded again."""
    ascii_text = F.regexp_replace("text", r"[^\x{00}-\x{7F}]", "")
    written = []
    for name in ("Windows-1251", "ISO-8859-5"):
        high = _TWO_CASES[1].encode(SINGLE_BYTE[name]).decode("latin-1")
        content = F.encode(F.translate(ascii_text, _TWO_CASES[0], high), "ISO-8859-1")
        written.append(T.table(spark, folder, "documents").select("doc_id", F.lit(name).alias("encoding"), content.alias("content")))
    named = written[0].unionByName(written[1]).withColumn("detected", detect_encoding(F.col("content")))
    return named.select("doc_id", "encoding", "detected", decode_text(F.col("content"), F.col("detected")).alias("text"))


def _text_files(spark, folder):
    """Each document as a file of its own; the folder that holds them, on storage all executors reach."""
    root = f"{ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix='run-'))}/{uuid.uuid4().hex}"
    T.write_documents(spark, folder, f"{root}/in")
    return root


_STORED_SQL = f"""distinct_texts AS (SELECT DISTINCT text FROM documents),
    lines AS (SELECT md5(text || chr(10)) AS md5, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
              FROM distinct_texts),
    stored AS (SELECT md5, row_number() OVER (PARTITION BY md5 ORDER BY n) AS seq, {trimmed('line')} AS message,
               {_CONTENT_SQL.format('rtrim(line, chr(13))')} AS level FROM lines WHERE {trimmed('line')} <> '')"""


def _stored_entries(stored: catalog.Catalog) -> DataFrame:
    keys = stored.files().select(F.col("id").alias("file_id"), "md5")
    return stored.entries().join(keys, "file_id").select("md5", "seq", "message", "level")


@register("ingest_documents", f"WITH {_STORED_SQL} SELECT * FROM stored")
def ingest_documents(spark, folder):
    """Documents written as files, ingested, and read from the catalogue; copies are refused as duplicates."""
    root = _text_files(spark, folder)
    catalog.ingest(spark, f"{root}/in", f"{root}/catalog", "b1")
    return _stored_entries(catalog.Catalog(spark, f"{root}/catalog"))


@register("ingest_stream_documents", f"WITH {_STORED_SQL} SELECT * FROM stored")
def ingest_stream_documents(spark, folder):
    """The same through a stream that admits some megabytes of files at a time."""
    root = _text_files(spark, folder)
    size = max(1 << 20, T.table(spark, folder, "documents").agg(F.sum(F.octet_length("text"))).first()[0] // 2)
    ingest_stream(spark, f"{root}/in", f"{root}/catalog", f"{root}/check", bytes_per_trigger=size, available_now=True).awaitTermination()
    return _stored_entries(catalog.Catalog(spark, f"{root}/catalog"))


@register(
    "ingest_report",
    """WITH kept AS (SELECT text, count(*) AS copies FROM documents GROUP BY text)
    SELECT md5(text || chr(10)) AS md5, copies, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS file_size, 'parsed' AS status, 'UTF-8' AS encoding,
    copies - 1 AS refused FROM kept""",
)
def ingest_report(spark, folder):
    """What the report of a batch and the rows of its files say of each content."""
    root = _text_files(spark, folder)
    report = catalog.ingest(spark, f"{root}/in", f"{root}/catalog", "b1")
    by_key = report.groupBy("md5").agg(
        F.count(F.lit(1)).alias("copies"), F.count(F.when((F.col("status") == "duplicate") & F.col("existing_upload_id").isNotNull(), 1)).alias("refused"))
    files = catalog.Catalog(spark, f"{root}/catalog").files()
    return files.join(by_key, "md5").select("md5", "copies", F.col("summary.file_size").alias("file_size"), "status", "encoding", "refused")


@register(
    "resummarize_documents",
    f"""WITH {_STORED_SQL}, counted AS (SELECT md5, coalesce(level, 'unknown') AS level, count(*) AS n FROM stored GROUP BY ALL)
    SELECT md5, CAST(sum(n) AS BIGINT) AS record_count, CAST(sum(n) AS BIGINT) AS total_records,
    CAST(coalesce(sum(n) FILTER (WHERE level = 'unknown'), 0) AS BIGINT) AS unknown, 'seen again' AS note FROM counted GROUP BY md5""",
)
def resummarize_documents(spark, folder):
    """Stored entries summarised again with a summariser that was not there when they were ingested."""
    root = _text_files(spark, folder)
    catalog.ingest(spark, f"{root}/in", f"{root}/catalog", "b1")
    stored = catalog.Catalog(spark, f"{root}/catalog")
    summaries.register_summarizer("text", lambda entries: entries.select("file_id").distinct().withColumn(
        "extras", F.create_map(F.lit("note"), F.lit("seen again"))))
    try:
        files = stored.resummarize("r1")
    finally:
        summaries.unregister_summarizer("text")
    return files.where("record_count > 0").select(
        "md5", "record_count", F.col("summary.total_records").alias("total_records"),
        F.coalesce(F.col("summary.level_counts")["unknown"], F.lit(0)).alias("unknown"), F.col("summary.extras")["note"].alias("note"))


def _semicolon_batch(raw, default_tz):
    """A format no Column takes apart: key=value texts in any order."""
    rows = [dict(item.split("=", 1) for item in line[3:].split(";")) for line in raw]
    return pd.DataFrame({
        "ts_text": [r.pop("at") for r in rows], "level": [r.pop("sev") for r in rows], "component": [r.pop("who") for r in rows],
        "message": [" ".join(sorted(r.values())) for r in rows], "attrs": rows,
    })


@register(
    "custom_format",
    f"""WITH {ENTRIES_SQL} SELECT event_id, date_trunc('milliseconds', ts) AS ts, 'Z' AS tz_offset,
    CASE event_type WHEN 'error' THEN 'critical' ELSE 'info' END AS level, 'p' || CAST(user_id AS VARCHAR) AS component,
    least('a' || CAST(event_id AS VARCHAR), event_type) || ' ' || greatest('a' || CAST(event_id AS VARCHAR), event_type) AS message,
    event_type AS kind FROM entries""",
)
def custom_format(spark, folder):
    """Records of a registered format with a parser over Arrow batches."""
    ship_package(spark)
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
    raw = F.concat(
        F.lit("kv "), F.lit("kind="), "event_type", F.lit(";who=p"), "user_id", F.lit(";at="), at, F.lit(";id=a"), "event_id", F.lit(";sev="),
        F.when(F.col("event_type") == "error", "FATAL").otherwise("notice"))
    records = T.table(spark, folder, "events").select("event_id", F.lit("kv").alias("format"), raw.alias("raw_line"))
    register_format(FormatSpec("kv", head="kv ", parse_batch=_semicolon_batch))
    try:
        parsed = assembly.parse_records(records)
    finally:
        unregister_format("kv")
    return parsed.select("event_id", "ts", "tz_offset", "level", "component", "message", attr(F.col("attrs"), "kind").alias("kind"))


def _zipped(batches):
    """Each text as an archive of its own with one log and one other member."""
    for batch in batches:
        contents = []
        for text in batch["text"]:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("logs/doc.log", text)
                archive.writestr("logs/doc.bin", "no text")
            contents.append(buffer.getvalue())
        yield batch.assign(content=contents)[["doc_id", "content"]]


@register(
    "zip_members",
    "SELECT doc_id, 'logs/doc.log' AS path_in_archive, 'doc.log' AS member_name, text FROM documents",
)
def zip_members(spark, folder):
    archives = T.table(spark, folder, "documents").select("doc_id", "text").mapInPandas(_zipped, "doc_id bigint, content binary")
    archives = archives.select(F.col("doc_id").cast("string").alias("key"), "content")
    members = expand_archives(archives, "key").withColumn("doc_id", F.col("key").cast("bigint"))
    text = decode_text(F.col("content"), detect_encoding(F.col("content")))
    return members.select("doc_id", "path_in_archive", "member_name", text.alias("text"))


@register(
    "cascade_upload",
    f"""WITH {ENTRIES_SQL}, {FILES_SQL}, gone AS (SELECT 'u' || CAST(r_regionkey AS VARCHAR) AS id FROM region WHERE r_name = 'AMERICA')
    SELECT 'files' AS name, upload_id, count(*) AS n FROM files WHERE upload_id NOT IN (SELECT id FROM gone) GROUP BY 2
    UNION ALL SELECT 'entries', upload_id, count(*) FROM entries WHERE upload_id NOT IN (SELECT id FROM gone) GROUP BY 2""",
)
def cascade_upload(spark, folder):
    gone = T.table(spark, folder, "region").where("r_name = 'AMERICA'").select(F.concat(F.lit("u"), "r_regionkey").alias("id"))
    left = intake.delete_uploads(
        {"files": T.files_from_events(spark, folder), "entries": T.entries_from_events(spark, folder)}, gone)
    counted = [
        left[name].groupBy("upload_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "upload_id", "n")
        for name in ("files", "entries")
    ]
    return counted[0].unionByName(counted[1])


@register(
    "cascade_file",
    f"""WITH {ENTRIES_SQL}, {FILES_SQL}, gone AS (SELECT 'f' || CAST(n_nationkey AS VARCHAR) AS id FROM nation)
    SELECT 'files' AS name, id AS file_id, record_count AS n FROM files WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'entries', file_id, count(*) FROM entries WHERE file_id NOT IN (SELECT id FROM gone) GROUP BY 2""",
)
def cascade_file(spark, folder):
    gone = T.table(spark, folder, "nation").select(F.concat(F.lit("f"), "n_nationkey").alias("id"))
    left = intake.delete_files(
        {"files": T.files_from_events(spark, folder), "entries": T.entries_from_events(spark, folder)}, gone)
    files = left["files"].select(F.lit("files").alias("name"), F.col("id").alias("file_id"), F.col("record_count").alias("n"))
    entries = left["entries"].groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return files.unionByName(entries.select(F.lit("entries").alias("name"), "file_id", "n"))


# ---- views (J6-J8, U15, V) ---------------------------------------------------

RULES = [("eaux", "#ef4444"), ("TION", "#f59e0b"), ("the ", "#10b981"), ("un", "#3b82f6")]


@register(
    "highlight_first_rule",
    "SELECT CAST(doc_id AS VARCHAR) AS file_id, CASE "
    + " ".join(f"WHEN contains(lower(text || ' ' || text || ' ' || lang || ' '), lower('{t}')) THEN '{c}'" for t, c in RULES)
    + " END AS color FROM documents",
)
def highlight_first_rule(spark, folder):
    return views.highlight(T.entries_from_documents(spark, folder), RULES).select("file_id", "color")


@register(
    "highlight_rule_table",
    f"""WITH {ENTRIES_SQL}, rules AS (SELECT 'u' || CAST(n_nationkey % 5 AS VARCHAR) AS upload_id, n_nationkey AS id,
      CAST(n_nationkey AS VARCHAR) AS text, n_name AS color FROM nation)
    SELECT e.seq, e.file_id, min_by(r.color, r.id) AS color FROM entries e LEFT JOIN rules r ON r.upload_id = e.upload_id
      AND contains(lower(e.message || ' ' || e.raw_line || ' ' || e.component || ' ' || coalesce(e.level, '')), r.text)
    GROUP BY 1, 2""",
)
def highlight_rule_table(spark, folder):
    rules = T.table(spark, folder, "nation").select(
        F.concat(F.lit("u"), F.col("n_nationkey") % 5).alias("upload_id"), F.col("n_nationkey").alias("id"),
        F.col("n_nationkey").cast("string").alias("text"), F.col("n_name").alias("color"), F.lit(0).alias("created_at"))
    return views.highlight(T.entries_from_events(spark, folder), rules).select("seq", "file_id", "color")


_MARKUP_SQL = "text"
for _text, _color in [("the", "#ef4444"), ("mark", "#f59e0b"), ("É", "#10b981")]:
    _MARKUP_SQL = f"""regexp_replace({_MARKUP_SQL}, '{_text}', '<mark style="background:{_color}40">\\0</mark>', 'gi')"""


@register("highlight_markup", f"SELECT doc_id, {_MARKUP_SQL} AS marked FROM documents")
def highlight_markup(spark, folder):
    rules = [("the", "#ef4444"), ("mark", "#f59e0b"), ("É", "#10b981")]
    return views.highlight_markup(T.table(spark, folder, "documents"), rules, "text").select("doc_id", "marked")


def _annotations(spark, folder):
    """Pins made of events: purchases pin a time, sign-ups a record, the rest is faulty in its own way."""
    kind, ts = F.col("component"), F.col("ts")
    entries = T.entries_from_events(spark, folder)
    return entries.select(
        F.concat(F.lit("a"), "seq").alias("id"), "upload_id",
        F.when(kind.isin("signup", "error", "view"), F.col("file_id")).alias("file_id"),
        F.when(kind.isin("signup", "view"), F.col("seq")).alias("entry_id"),
        F.when(kind.isin("purchase", "view"), ts).alias("ts"),
        F.when(kind == "click", "").otherwise(F.col("message")).alias("note"),
        F.lit("#ef4444").alias("color"),
    )


_ANNOTATIONS_SQL = """ann AS (SELECT 'a' || CAST(seq AS VARCHAR) AS id, upload_id,
  CASE WHEN event_type IN ('signup', 'error', 'view') THEN file_id END AS file_id,
  CASE WHEN event_type IN ('signup', 'view') THEN seq END AS entry_id,
  CASE WHEN event_type IN ('purchase', 'view') THEN ts END AS ts,
  CASE WHEN event_type = 'click' THEN '' ELSE message END AS note, '#ef4444' AS color FROM entries)"""


@register(
    "annotations_resolved",
    f"""WITH {ENTRIES_SQL}, {_ANNOTATIONS_SQL}, named AS (SELECT 'f' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS filename FROM supplier)
    SELECT ann.id, ann.file_id, filename, ann.ts IS NULL AND filename IS NULL AS dangling FROM ann LEFT JOIN named ON named.id = ann.file_id""",
)
def annotations_resolved(spark, folder):
    files = T.table(spark, folder, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("id"), F.col("s_name").alias("filename"))
    return views.resolve_annotations(_annotations(spark, folder), files).select("id", "file_id", "filename", "dangling")


@register(
    "annotation_markers",
    f"""WITH {ENTRIES_SQL}, {_ANNOTATIONS_SQL}, shown AS (SELECT DISTINCT strftime(ts, '%Y-%m-%dT%H') AS bucket FROM entries WHERE level = 'error')
    SELECT ann.id AS annotation_id, bucket, color, note FROM ann JOIN shown ON bucket = strftime(ann.ts, '%Y-%m-%dT%H')""",
)
def annotation_markers(spark, folder):
    shown = aggregates.histogram(T.entries_from_events(spark, folder).where(entry_filter(level="error")), "hour")
    return views.annotation_markers(_annotations(spark, folder), shown, "hour")


@register(
    "annotations_validated",
    f"""WITH {ENTRIES_SQL}, {_ANNOTATIONS_SQL} SELECT id, CASE WHEN note = '' OR color = '' THEN 'note and color are required'
      WHEN file_id IS NOT NULL AND entry_id IS NOT NULL AND ts IS NOT NULL THEN 'only one kind of pin is allowed'
      WHEN (file_id IS NULL OR entry_id IS NULL) AND ts IS NULL THEN 'either ts or file_id with entry_id is required'
      WHEN (file_id IS NOT NULL) <> (entry_id IS NOT NULL) THEN 'file_id and entry_id must be given together' END AS error FROM ann""",
)
def annotations_validated(spark, folder):
    return views.validate_annotations(_annotations(spark, folder)).select("id", "error")


@register(
    "rules_validated",
    "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN 'text and color are required' END AS error FROM customer",
)
def rules_validated(spark, folder):
    rules = T.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("text"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("color"))
    return views.validate_rules(rules, "highlights").select("id", "error")


SAVED_FILTERS = [
    ("search", json.dumps({"q": "user=1", "fields": "raw"})),
    ("search", json.dumps({"q": "^(click|error)", "mode": "regex"})),
    ("timeline", json.dumps({"from": "2024-01-03T00:00:00Z", "to": "2024-01-25T00:00:00Z"})),
]

_SAVED_SQL = ("raw_line ILIKE '%user=1%'", _any_field("regexp_matches({0}, '^(click|error)')"),
              "(ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00')")


@register("apply_filters", _hits_sql(" AND ".join(_SAVED_SQL)))
def apply_filters(spark, folder):
    return views.apply_filters(T.entries_from_events(spark, folder), SAVED_FILTERS).select(*COLUMNS)


@register("apply_filters_any", _hits_sql(f"({_SAVED_SQL[0]} OR {_SAVED_SQL[1]}) AND {_SAVED_SQL[2]}"))
def apply_filters_any(spark, folder):
    return views.apply_filters(T.entries_from_events(spark, folder), SAVED_FILTERS, "or").select(*COLUMNS)


PRESET = {
    "searchFilters": [{"q": "value=", "fields": "all"}, {"q": "k", "fields": "raw", "attrs": "k:1"}],
    "timeline": {"from": "2024-01-02T00:00:00Z", "to": ""},
    "highlights": [{"text": "ERROR", "color": "#ef4444", "lexeme": 0}, {"text": "click", "color": "#10b981", "lexeme": 0}],
    "selectedFileIds": ["f1", "f2", "f3", "f4", "f5", "f6", "f7"],
    "correlateMode": True,
    "pageSize": 25,
}


@register(
    "apply_preset",
    _CORRELATE_SQL + f""" SELECT {_COLS}, filename, CASE WHEN contains(lower(message || ' ' || raw_line || ' ' || component), 'error')
      THEN '#ef4444' WHEN contains(lower(message || ' ' || raw_line || ' ' || component), 'click') THEN '#10b981' END AS color
    FROM joined WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND file_id IN ('f1','f2','f3','f4','f5','f6','f7') AND k LIKE '%1%'
    ORDER BY ts NULLS LAST, seq, file_id LIMIT 25""",
)
def apply_preset(spark, folder):
    shown = views.apply_preset(
        T.entries_from_events(spark, folder), T.files_from_events(spark, folder), None, json.dumps(PRESET))
    return shown.select(*COLUMNS, "filename", "color")


@register(
    "clear_view_state",
    """SELECT 'filters' AS name, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    UNION ALL SELECT 'highlights', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING'""",
)
def clear_view_state(spark, folder):
    customers = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("upload_id"), "c_mktsegment")
    filters = T.table(spark, folder, "orders").select(F.col("o_custkey").alias("upload_id"))
    left = views.clear_view_state(filters, customers, customers.where("c_mktsegment = 'BUILDING'"))
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
               for name, df in zip(("filters", "highlights"), left)]
    return counted[0].unionByName(counted[1])
