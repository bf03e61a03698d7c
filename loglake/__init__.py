"""A PySpark-native log analytics engine.

Sources and assembly turn files into records, formats turn records into entries, and
the operators answer questions over entries. Everything takes and returns DataFrames or
Columns.
"""

from loglake.operators.aggregates import (
    histogram,
    histogram_total,
    lexemes,
    stack_totals,
    storage_stats,
    term_counts,
    timeline,
    upload_detail,
)
from loglake.operators.assembly import (
    assemble_lines,
    clean_text,
    detect_lines,
    detect_text,
    number_lines,
    parse_records,
    split_records,
)
from loglake.operators.formats import FormatSpec, formats, parts, register_format, unregister_format
from loglake.operators.intake import delete_files, delete_uploads, duplicate_report, upload_report
from loglake.operators.pages import correlate, file_entries, files_list, search, uploads_list
from loglake.operators.predicates import entry_filter
from loglake.operators.summaries import (
    base_summary,
    level_counts,
    register_summarizer,
    session_stats,
    sessions,
    summarize,
    unregister_summarizer,
)
from loglake.operators.views import (
    annotation_markers,
    apply_filters,
    apply_preset,
    clear_view_state,
    highlight,
    highlight_markup,
    resolve_annotations,
    validate_annotations,
    validate_rules,
)
from loglake.plans.catalog import Catalog, ingest
from loglake.session import build_session
from loglake.streaming.ingest import ingest_stream

__all__ = [
    "Catalog", "FormatSpec", "annotation_markers", "apply_filters", "apply_preset", "assemble_lines", "base_summary",
    "build_session", "clean_text", "clear_view_state", "correlate", "delete_files", "delete_uploads", "detect_lines",
    "detect_text", "duplicate_report", "entry_filter", "file_entries", "files_list", "formats", "highlight",
    "highlight_markup", "histogram", "histogram_total", "ingest", "ingest_stream", "level_counts", "lexemes",
    "number_lines", "parse_records", "parts", "register_format", "register_summarizer", "resolve_annotations", "search",
    "session_stats", "sessions", "split_records", "stack_totals", "storage_stats", "summarize", "term_counts", "timeline",
    "unregister_format", "unregister_summarizer", "upload_detail", "upload_report", "uploads_list", "validate_annotations",
    "validate_rules",
]
